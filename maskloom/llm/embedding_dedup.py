"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. After an orthogonal rotation they are
cut into blocks; if the whole squared distance is within the bound, some block's is within its
proportional share. A pair is taken by the first block that admits it, and its cosine is verified in
double precision on the original vectors. The rotation is to the principal axes of a bounded
sample (of each vector length; a rotation keeps distances whatever it is fitted on), the axes of
most spread dealt over the blocks, each block's first.

Each block is range-joined on its first axis: cells are two radii wide and a vector within one
radius of the upper edge also goes to the next cell, so each close pair meets in exactly one cell.
Where the sample shows that the cells of all blocks would hold more pairs than there are (vectors
spread alike over all axes), vectors are placed once instead, and all blocks are joined in the same
task. Within a task, a block is joined on its first LEAD axes, and only pairs within the share there are
looked at further. Cells are dealt in parts of bounded size, each pair of parts on its own. A task
returns link counts and a spanning forest, never its pairs.

Only equal, non-null labels are compared. Equal vectors enter once, with a count. Cases: vectors
that are null, zero or hold null or non-finite components link with nothing and are their own
component; vectors of another length are compared within their length; rows of one vec_id are
one vector (the smallest decides); a null vec_id links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from maskloom.llm.common import partitions, stash
from maskloom.llm.components import Forest, components
from maskloom.llm.near_dedup import _grouped

BLOCKS, LEAD = 4, 6


def plain_vectors(df: DataFrame, column: str) -> str:
    """The array type in which a column keeps its precision: of floats if it has them, else of doubles."""
    kind = getattr(df.schema[column].dataType, "elementType", None)
    return "array<float>" if isinstance(kind, FloatType) else "array<double>"


def usable(column: str):
    """Whether a vector has only finite components and isn't zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def scaled(embedding) -> np.ndarray:
    """Vectors in double precision; those too large or small for their squares are scaled by a power of two, which changes no cosine."""
    x = np.stack(embedding).astype(np.float64)
    top = np.abs(x).max(1)
    off = (top > 1e100) | (top < 1e-100)
    x[off] = np.ldexp(x[off], -np.frexp(top[off])[1][:, None])
    return x


class Layout:
    """Rotation and blocks of the vectors of one length."""

    def __init__(self, sample: np.ndarray, bound: float):
        dim = sample.shape[1]
        self.blocks = min(BLOCKS, dim)
        _, axes = np.linalg.eigh(sample.T @ sample)
        order = np.concatenate([np.arange(dim)[b :: self.blocks] for b in range(self.blocks)])  # axis 0 has most spread
        self.axes = axes[:, ::-1][:, order]
        self.parts = np.split(np.arange(dim), np.cumsum([len(range(b, dim, self.blocks)) for b in range(self.blocks)])[:-1])
        self.share = bound / self.blocks * (1 + 1e-9) + 1e-12
        self.radius = float(np.sqrt(self.share)) * (1 + 1e-9)
        y = sample @ self.axes
        met = 0.0
        for part in self.parts:
            cell, spills = self.cells(y[:, part[0]])
            at, n = np.unique(np.concatenate([cell, cell[spills] + 1]), return_counts=True)
            met += float((n.astype(float) ** 2).sum()) / len(y) ** 2
        self.merged = met >= 1.0  # cells of all blocks hold more pairs than there are

    def cells(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and whether it goes to the next one as well."""
        cell = np.floor(first / (2 * self.radius)).astype(np.int32)
        return cell, (cell + 1) * (2 * self.radius) - first <= self.radius

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.sqrt((x * x).sum(1))[:, None]) @ self.axes


def _replicate(rows: DataFrame, layouts, kind: str) -> DataFrame:
    """Each vector at its cells: block number (-1: all), cell, and whether it is at home there."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                own = layouts.value[dim]
                if own.merged:
                    yield part.assign(dim=np.int32(dim), block=np.int32(-1), cell=np.int32(0), home=True)
                    continue
                y = own.rotated(scaled(part["embedding"]))
                for block, columns in enumerate(own.parts):
                    cell, spills = own.cells(y[:, columns[0]])
                    base = part.assign(dim=np.int32(dim), block=np.int32(block), cell=cell, home=True)
                    yield base
                    if spills.any():
                        yield base[spills].assign(cell=cell[spills] + np.int32(1), home=False)

    return rows.mapInPandas(run, f"node long, label long, n long, embedding {kind}, dim int, block int, cell int, home boolean")


def pairs_in(own: Layout, y: np.ndarray, x: np.ndarray, block: int, cosine: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``rows`` x ``columns``) that ``block`` is the first to admit and whose cosine reaches ``cosine``."""

    def apart(i, j, axes):
        return ((y[i][:, axes] - y[j][:, axes]) ** 2).sum(1)

    lead = own.parts[block][:LEAD]
    a, b = y[rows][:, lead], y[columns][:, lead]
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(square <= own.share + 1e-9)
    i, j = rows[i], columns[j]
    ok = apart(i, j, own.parts[block]) <= own.share
    i, j = i[ok], j[ok]
    ok = np.ones(len(i), bool)
    for k in range(block):
        ok &= apart(i, j, own.parts[k]) > own.share
    i, j = i[ok], j[ok]
    norm = np.sqrt((x * x).sum(1))
    c = (x[i] * x[j]).sum(1) / (norm[i] * norm[j])
    return i[c >= cosine], j[c >= cosine]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, most: int = 4096, sample: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = plain_vectors(vectors, "embedding")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    good = ids.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    good = stash(good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"), "vectors")
    nodes = stash(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "nodes")
    layouts = spark.sparkContext.broadcast(_layouts(nodes, 2 - 2 * cosine, sample))
    placed = stash(_replicate(nodes.select("node", "label", "n", "embedding"), layouts, kind), "placed")
    by = ["label", "dim", "block", "cell"]
    sizes = placed.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("k"))
    rows = placed.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("node", "n", "embedding", "home", "part", *by, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    keys = [*by, "p", "q"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, dim, block, _, p, q), group in _grouped(batches, keys):
            own = layouts.value[int(dim)]
            found = link(own, group, range(own.blocks) if block < 0 else [int(block)], p == q)
            if len(found):
                yield found

    def link(own: Layout, g: pd.DataFrame, blocks, alone: bool) -> pd.DataFrame:
        x = scaled(g["embedding"])
        y = own.rotated(x)
        home, node, n = g["home"].to_numpy(), g["node"].to_numpy(), g["n"].to_numpy()
        part = g["part"].to_numpy()
        links, forest, edges = np.zeros(len(g), np.int64), Forest(), []
        left = np.arange(len(g)) if alone else np.flatnonzero(part == part.min())
        right = left if alone else np.flatnonzero(part != part.min())
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            for block in blocks:
                i, j = pairs_in(own, y, x, block, cosine, some, right[right > at] if alone else right)
                keep = (home[i] | home[j]) & ((i < j) if alone else True)  # two visitors meet in the cell before
                i, j = i[keep], j[keep]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                edges += [(a, b) for a, b in zip(node[i].tolist(), node[j].tolist()) if forest.join(a, b)]
        seen = np.flatnonzero(links)
        counted = pd.DataFrame({"a": node[seen], "b": node[seen], "links": links[seen]})
        return pd.concat([counted, pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": 0})]).astype("int64")

    dealt = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    found = stash(dealt.mapInPandas(run, "a long, b long, links long"), "links")
    degree = found.filter("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    classes = components(found.filter("a <> b").select("a", "b"))
    known = nodes.join(degree, nodes["node"] == degree["a"], "left").drop("a").join(classes, "node", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    each = good.join(known, ["label", "embedding"]).select(F.col("vec_id").alias("id"), "n_links", "component_id")
    out = ids.join(each, ids["vec_id"] == each["id"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _layouts(nodes: DataFrame, bound: float, sample: int) -> dict[int, Layout]:
    """For each vector length, a layout fitted on about ``sample`` unit vectors of smallest key hash."""
    lengths = {r["dim"]: r["count"] for r in nodes.groupBy(F.size("embedding").alias("dim")).count().collect()}  # a row for each length
    least = F.lit(0.0)
    for dim, n in lengths.items():
        least = F.when(F.size("embedding") == dim, F.lit(sample / n)).otherwise(least)
    some: dict[int, list] = {dim: [] for dim in lengths}
    for r in nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < least * (1 << 30)).select("embedding").collect():
        some[len(r.embedding)].append(r.embedding)
    out = {}
    for dim, rows in some.items():
        x = scaled(rows) if rows else np.eye(dim)
        out[dim] = Layout(x / np.sqrt((x * x).sum(1))[:, None], bound)
    return out


ORACLE = """
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM u UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT u.vec_id, (SELECT count(*) FROM l WHERE l.a = u.vec_id) AS n_links, m.component_id, u.vec_id = m.component_id AS kept
FROM u JOIN m ON m.a = u.vec_id"""
