"""Approximate nearest neighbours by an inverted multi-index.

The unit vectors' halves are quantised separately by k-means fitted on a bounded sample (about
``sample`` vectors of each length, those of smallest key hash), with a fourth as many centroids
as vectors, ``centroids`` at most; every vector is indexed by its pair of centroids. A query walks the
pairs in order of summed distance with a heap until the cells passed hold ``share`` of all n vectors
and ``root`` times the root of n more: a smaller part of a larger table, by one rule at every size. The
entries of those cells are reranked by exact cosine in double precision.

Entries are dealt in shards of about ``most``, cell after cell, a large cell to several; a query goes
once to each shard that holds cells it passed, with the distance at which its walk ended, and streams
by the shard's entries, which are not copied. Equal query vectors ask once. Of equal vectors the
smallest ids that can still rank are entries, which is exact. A task gives the best k + 1 for a query.

On vectors without structure neighbours lie in many cells, so recall 0.9 needs a fifth of the table.

Cases: vectors that are null, zero or hold null or non-finite components, and null vec_ids, take no
part; of rows of one vec_id the smallest counts; vectors are searched among those of their length;
ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskloom.llm.common import partitions, stash
from maskloom.llm.embedding_dedup import plain_vectors, scaled, usable


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of ``x``; the first ones are spread by a fixed random draw."""
    rng = np.random.default_rng(7)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1) if x.shape[1] else c
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[at : at + 4096], c).argmin(1) for at in range(0, len(x), 4096)])


def unit(embedding) -> np.ndarray:
    x = scaled(embedding)
    return x / np.sqrt((x * x).sum(1))[:, None]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


class Index:
    """The centroids of both halves of the vectors of one length, and where the entries of occupied cells are."""

    def __init__(self, fit_on: np.ndarray, centroids: int):
        self.a, self.b = (kmeans(h, centroids) for h in halves(fit_on))
        self.cells = self.held = self.shard = self.blocks = self.row = np.zeros(0, np.int64)
        self.enough = 0

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        a, b = halves(x)
        return nearest(a, self.a) * len(self.b) + nearest(b, self.b)

    def fill(self, cells: np.ndarray, held: np.ndarray, share: float, root: float, most: int) -> None:
        order = np.argsort(cells)
        self.cells, self.held = cells[order], held[order]
        self.shard = (np.cumsum(self.held) - self.held) // most
        self.blocks = -(-self.held // most)
        self.row = np.searchsorted(self.cells, np.arange(len(self.a) + 1) * len(self.b))
        n = int(held.sum())
        self.enough = min(n, int(np.ceil(share * n + root * np.sqrt(n))))

    def walk(self, da: np.ndarray, db: np.ndarray) -> tuple[list[int], float]:
        """Occupied cells (their numbers in ``cells``) in order of da + db until they hold enough, and the last sum.

        The heap has the next cell of each first centroid, whose cells are in order of their second one.
        """
        total = np.repeat(da, np.diff(self.row)) + db[self.cells % len(self.b)]
        order = np.lexsort((total, self.cells // len(self.b)))
        sums, row, held = total[order].tolist(), self.row.tolist(), self.held[order].tolist()
        heap = [(sums[at], at, stop) for at, stop in zip(row, row[1:]) if at < stop]
        heapq.heapify(heap)
        out, got, last = [], 0, -np.inf
        while heap and got < self.enough:
            last, at, stop = heap[0]
            out.append(at)
            got += held[at]
            if at + 1 < stop:
                heapq.heapreplace(heap, (sums[at + 1], at + 1, stop))
            else:
                heapq.heappop(heap)
        return order[out].tolist(), float(last)


def search(vectors: DataFrame, is_query: Column, k: int = 5, centroids: int = 1024, share: float = 0.15, root: float = 5.0, sample: int = 16_384, most: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query``, its ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    kind = plain_vectors(vectors, "embedding")
    rows = vectors.withColumn("q", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "q")
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("embedding")).groupBy("vec_id").agg(F.min(F.struct("embedding", "q")).alias("v")).select("vec_id", "v.*")
    rows = stash(rows.withColumn("dim", F.size("embedding")), "vectors")
    # of equal vectors only the k + 1 smallest ids can rank; Spark limits the groups before the shuffle, too
    copies = W.partitionBy("embedding").orderBy("vec_id")
    entries = rows.select("dim", "vec_id", "embedding").withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).drop("nth")
    entries = stash(entries, "entries")
    lengths = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}  # a row for each length of vectors
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = F.lit(0.0)
    for dim, n in lengths.items():
        least = F.when(F.col("dim") == dim, F.lit(sample / n)).otherwise(least)
    chosen = entries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < least * (1 << 30)).select("dim", "vec_id", "embedding")
    fit_on: dict[int, list] = {}
    for r in sorted(chosen.collect(), key=lambda r: r.vec_id):  # about ``sample`` vectors of each length
        fit_on.setdefault(r.dim, []).append(r.embedding)
    for dim in lengths.keys() - fit_on.keys():
        fit_on[dim] = [entries.filter(F.col("dim") == dim).first().embedding]
    index = {dim: Index(unit(some), max(1, min(centroids, lengths[dim] // 4))) for dim, some in fit_on.items()}
    books = spark.sparkContext.broadcast(index)  # the centroids

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                yield part.assign(cell=books.value[dim].cell_of(unit(part["embedding"])))

    indexed = stash(entries.mapInPandas(place, f"dim int, vec_id long, embedding {kind}, cell long"), "index")
    table = indexed.groupBy("dim", "cell").count().toArrow()  # no more rows than pairs of centroids
    of, cells, held = (table[c].to_numpy() for c in ("dim", "cell", "count"))
    for dim, own in index.items():
        own.fill(cells[of == dim], held[of == dim], share, root, most)
    sent = spark.sparkContext.broadcast(index)
    asked = rows.filter("q").select("vec_id", "embedding", "dim")
    leads = asked.groupBy("dim", "embedding").agg(F.min("vec_id").alias("vec_id"))

    def dealt_entries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own = sent.value[dim]
                at = np.searchsorted(own.cells, part["cell"].to_numpy())
                yield part.assign(shard=own.shard[at] + part["vec_id"].to_numpy() % own.blocks[at], kind=np.int32(0), reach=0.0)

    def dealt_queries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own = sent.value[dim]
                a, b = halves(unit(part["embedding"]))
                where, reaches = [], []
                for da, db in zip(distances(a, own.a), distances(b, own.b)):
                    met, reach = own.walk(da, db)
                    first, more = own.shard[met], own.blocks[met]
                    where.append(np.unique(np.repeat(first - (np.cumsum(more) - more), more) + np.arange(more.sum())))
                    reaches.append(reach)
                n = [len(w) for w in where]
                part = part.loc[part.index.repeat(n)].reset_index(drop=True)
                yield part.assign(cell=0, shard=np.concatenate(where), kind=np.int32(1), reach=np.repeat(reaches, n))

    schema = f"dim int, vec_id long, embedding {kind}, cell long, shard long, kind int, reach double"
    stored, probes = indexed.mapInPandas(dealt_entries, schema), leads.select("dim", "vec_id", "embedding").repartition(partitions(spark)).mapInPandas(dealt_queries, schema)
    keys = ["dim", "shard"]
    met = stored.unionByName(probes).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "kind", "vec_id")

    def rank(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Entries of a shard come first; queries stream by them."""
        now, kept, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            mark = batch["dim"].to_numpy() * 2 + batch["kind"].to_numpy() + (batch["shard"].to_numpy() << 40)
            cuts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1], True])
            for at, stop in zip(cuts, cuts[1:]):
                part = batch.iloc[at:stop]
                key = (int(part["dim"].iloc[0]), int(part["shard"].iloc[0]))
                if key != now:
                    now, kept, ready = key, [], None
                if part["kind"].iloc[0] == 0:
                    kept.append(part)
                elif kept:
                    ready = ready or Shard(pd.concat(kept), sent.value[key[0]])
                    for a in range(0, len(part), 256):
                        yield ready.best(part.iloc[a : a + 256], k + 1)

    found = met.mapInPandas(rank, "lead long, near long, score double")
    top = W.partitionBy("lead").orderBy(F.desc("score"), "near")
    best = found.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1).drop("nth")
    who = asked.join(leads.withColumnRenamed("vec_id", "lead"), ["dim", "embedding"]).select("vec_id", "lead")
    pairs = who.join(best, "lead").filter("near <> vec_id")
    place_of = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "near"))
    return pairs.withColumn("rank", place_of).filter(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("near").alias("vec_id"), "score")


class Shard:
    """Entries of some cells, to be ranked for the queries that passed them."""

    def __init__(self, entries: pd.DataFrame, index: Index):
        self.index, self.ids = index, entries["vec_id"].to_numpy()
        self.x = scaled(entries["embedding"])
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.unit = self.x / self.norm[:, None]
        self.cell = entries["cell"].to_numpy()

    def best(self, queries: pd.DataFrame, n: int) -> pd.DataFrame:
        """The best ``n`` entries for each query, of the cells that its walk passed; of equal scores the smaller ids."""
        q, index = scaled(queries["embedding"]), self.index
        norm = np.sqrt((q * q).sum(1))
        a, b = halves(q / norm[:, None])
        away = distances(a, index.a)[:, self.cell // len(index.b)] + distances(b, index.b)[:, self.cell % len(index.b)]
        about = (q / norm[:, None]) @ self.unit.T
        about[away > queries["reach"].to_numpy()[:, None] + 1e-9] = -np.inf
        m = min(n, len(self.ids))
        floor = -np.partition(-about, m - 1, axis=1)[:, m - 1 : m] - 1e-9
        i, j = np.nonzero((about >= floor) & (about > -np.inf))
        exact = (q[i] * self.x[j]).sum(1) / (norm[i] * self.norm[j])
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        top = nth < n
        return pd.DataFrame({"lead": queries["vec_id"].to_numpy()[i[top]], "near": self.ids[j[top]], "score": exact[top]})
