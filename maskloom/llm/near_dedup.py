"""MinHash near-dedup of texts by BagMinHash on multisets of word shingles.

Signature: every distinct shingle of multiplicity c runs Poisson processes on (0, c] cut into
intervals (0,1], (1,2], (2,4], ... of the discretised weight. A point of an interval falls on one
unit cell and counts if the cell is below c, so the same shingle has the same points in every
document, and a component's minima agree with the weighted Jaccard probability. Points come in
rising order; a process ends once it passes the largest component, so a document costs its
shingles plus about m log m points.

Candidates: signatures are banded. In a bucket every text is verified against the one of
smallest id (a star). Buckets whose texts are still in several classes are dealt in blocks, by
texts and by words; each pair of blocks meets in one task with the texts, where every two texts of
different classes are compared over their whole multisets, unless links found there have joined
them already. A task returns a spanning forest, fewer links than it holds texts, never its pairs.
Copies share a digest of their multiset and enter once.

Words are the lower-cased text split at white space; shingles have five words. Cases: a text of
one to four words has one shingle of all its words; null and empty texts and those without words
link with nothing; rows of one doc_id are one document; rows with null doc_id take no part and
come back with a null class (``keep_one`` gives them keys of their own); an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskloom.llm.common import broadcast_if_small, partitions, stash
from maskloom.llm.components import Forest, components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(hashed) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(hashed))):
        out = mix(out * _STEP + hashed[k : k + n] + np.uint64(k + 1))
    return out


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(shingles(text), return_counts=True)


def shared(of: np.ndarray, n: np.ndarray, a: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarities from shared weights ``of`` and total weights ``n``, against the multiset ``a``."""
    return of / np.maximum(n + a[1].sum() - of, 1)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; of two empty ones 0."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Postings:
    """Multisets of a block of texts, by shingle: the similarities of one text with all of them at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([s[1].sum() for s in sets], np.int64)
        item = np.concatenate([s[0] for s in sets])
        order = np.argsort(item, kind="stable")
        self.item = item[order]
        self.text = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])[order]
        self.count = np.concatenate([s[1] for s in sets])[order]

    def similarities(self, one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        low = np.searchsorted(self.item, one[0], "left")
        met = np.searchsorted(self.item, one[0], "right") - low
        at = np.repeat(low - (np.cumsum(met) - met), met) + np.arange(met.sum())
        both = np.bincount(self.text[at], np.minimum(self.count[at], np.repeat(one[1], met)), len(self.n))
        return shared(both, self.n, one)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """BagMinHash values, float32, one row of ``size`` per multiset; rows of empty multisets are infinite."""
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    out = np.full(len(sets) * size, np.inf)
    if not len(doc):
        return out.reshape(len(sets), size).astype(np.float32)
    item = np.concatenate([s[0] for s in sets])
    count = np.concatenate([s[1] for s in sets])
    level, low, length = 0, 0, 1
    while len(doc):
        _points(out, doc, mix(item + np.uint64((int(_STEP) * (level + 1)) % 2**64)), count, low, length, size)
        low, level = low + length, level + 1
        length = low  # (1,2], (2,4], (4,8], ...
        more = count > low
        doc, item, count = doc[more], item[more], count[more]
    return out.reshape(len(sets), size).astype(np.float32)


def _points(out: np.ndarray, doc: np.ndarray, state: np.ndarray, count: np.ndarray, low: int, length: int, size: int) -> None:
    time = np.zeros(len(doc))
    while len(doc):
        state = mix(state + _STEP)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        other = mix(state ^ _MIX2)
        part = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        if length > 1:
            cell = ((other >> np.uint64(32)) * np.uint64(length) >> np.uint64(32)).astype(np.int64)
            valid = low + cell < count
            np.minimum.at(out, (doc * size + part)[valid], time[valid])
        else:
            np.minimum.at(out, doc * size + part, time)
        limit = out.reshape(-1, size).max(axis=1)
        go = time < limit[doc]
        doc, state, time, count = doc[go], state[go], time[go], count[go]


SIGNED = "doc_id long, digest binary, n long, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """Per document with words: digest of its multiset, its size, and band keys."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            held, sets, keys = 0, [], []
            for doc, text in zip(ids, texts):
                one = multiset(text)
                if len(one[0]):
                    sets.append(one)
                    keys.append(doc)
                    held += len(one[0])
                if held > 400_000:
                    yield rows(keys, sets)
                    held, sets, keys = 0, [], []
            if sets:
                yield rows(keys, sets)

    def rows(keys, sets) -> pd.DataFrame:
        values = signatures(sets).view(np.uint32).astype(np.uint64)
        band = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            band = mix(band * _STEP + values[:, r::ROWS] + np.uint64(1))
        return pd.DataFrame({
            "doc_id": keys,
            "digest": [xxhash.xxh3_128_digest(s[0].tobytes() + s[1].tobytes()) for s in sets],
            "n": [int(s[1].sum()) for s in sets],
            "bands": list(band.view(np.int64)),
        })

    return docs.filter("doc_id IS NOT NULL").mapInPandas(run, SIGNED)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id and other numbers) with texts; broadcast only while it is small, else shuffled."""
    return docs.join(broadcast_if_small(wanted, 16 * len(wanted.columns)), "doc_id")


def verify(docs: DataFrame, pairs: DataFrame, most: int = 256) -> DataFrame:
    """Those of ``pairs`` (a, b) whose multisets overlap by SIMILAR; ``a`` is parsed once per ``most`` partners.

    The members of one ``a`` are salted into groups of about ``most``, each with a copy of ``a``'s text.
    """
    pairs = stash(pairs.select("a", "b"), "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("k"))
    members = pairs.join(groups, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    leads = members.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("kind"))
    wanted = stash(members.unionByName(leads), "wanted")
    texts = _fetch(docs, wanted)
    dealt = texts.repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind", "doc_id")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, group = None, None
        for batch in batches:
            found = []
            for doc, text, a, salt, kind in zip(*[batch[c] for c in ("doc_id", "text", "a", "salt", "kind")]):
                if kind == 0:
                    if group != (a, salt):  # a repeated row of one document is read once
                        lead, group = multiset(text), (a, salt)
                elif overlap(lead, multiset(text)) >= SIMILAR:
                    found.append((a, doc))
            yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.select("doc_id", "text", "a", "salt", "kind").mapInPandas(run, "a long, b long").distinct()


def _open_buckets(buckets: DataFrame, classes: DataFrame, most: int, words: int) -> DataFrame:
    """Rows (key, doc_id, component, block, x, y) of buckets that still hold several classes, dealt in pairs of blocks.

    A block has about ``most`` texts of together about ``words`` words at most, so no task holds a whole
    large bucket. A bucket of two has no pair besides the star's.
    """
    placed = buckets.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("words"))
    k = F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("words") / words)).cast("int")
    rows = placed.join(open_.filter("lo < hi AND size > 2").select("key", k.alias("k")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("key", "doc_id", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _across(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links between classes, for each pair of blocks of ``rows``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in _grouped(batches, ["key", "x", "y"]):
            g = g.drop_duplicates("doc_id")  # a repeated row of one document is read once
            sets = [multiset(t) for t in g["text"]]
            found = forest_of(g["doc_id"].to_numpy(), g["component"].to_numpy(), g["block"].to_numpy(), sets)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    order = ["key", "x", "y"]
    dealt = _fetch(docs, rows).repartition(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "doc_id")
    return dealt.select(*order, "doc_id", "component", "block", "text").mapInPandas(run, "a long, b long").distinct()


def forest_of(ids: np.ndarray, classes: np.ndarray, block: np.ndarray, sets: list) -> list[tuple[int, int]]:
    """Links that join different classes of one block, or of two blocks with one another.

    Every two texts that end in different classes have been compared: of such a pair at least one isn't
    in the class that was the largest, and each such text is compared with all of the other block.
    """
    forest, found = Forest(), []
    names, sizes = np.unique(classes, return_counts=True)
    if len(names) < 2:
        return found
    largest = int(names[sizes.argmax()])
    low = block == block.min()
    sides = [(np.flatnonzero(low), np.flatnonzero(~low)), (np.flatnonzero(~low), np.flatnonzero(low))] if not low.all() else [(np.arange(len(ids)),) * 2]
    for mine, others in sides:
        loose = [i for i in mine.tolist() if forest.find(int(classes[i])) != forest.find(largest)]
        if not loose:
            continue
        index = Postings([sets[j] for j in others])
        for i in loose:
            if forest.find(int(classes[i])) == forest.find(largest):
                continue
            for j in others[index.similarities(sets[i]) >= SIMILAR].tolist():
                if forest.join(int(classes[i]), int(classes[j])):
                    found.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return found


def _grouped(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    """Groups of a stream that is sorted by ``by``; a group may span batches."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        new = (batch[by] != batch[by].shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(new, new[1:]):
            yield tuple(batch[by].iloc[a]), batch.iloc[a:b]
        rest = batch.iloc[new[-1] :]
    if rest is not None and len(rest):
        yield tuple(rest[by].iloc[0]), rest


def near_duplicates(docs: DataFrame, most: int = 2048, words: int = 1_000_000) -> DataFrame:
    """(doc_id, class_id, kept) of every document of ``docs`` (doc_id, text): class_id is the smallest doc_id
    reachable by links of similarity SIMILAR or more, kept says whether the document is that one.

    ``most`` and ``words`` bound what a task of the bucket join holds of one block; they change no result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(sign(docs), "signed")
    same = signed.groupBy("digest").agg(F.min("doc_id").alias("node"))
    texts = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands")).alias("first")).select("first.*")
    keys = texts.select("doc_id", "n", F.explode("bands").alias("key"))
    keys = stash(keys, "keys")
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    buckets = stash(keys.join(hubs.select("key", "hub"), "key"), "buckets")
    star = buckets.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = stash(verify(docs, star), "links")
    classes = stash(components(links), "classes")
    rows = stash(_open_buckets(buckets.drop("hub"), classes, most, words), "open")
    more = stash(_across(docs, rows), "links")
    if not more.isEmpty():
        classes = stash(components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "classes")
    copies = signed.select("digest", "doc_id").distinct().join(same, "digest").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    copied = copies.join(classes.withColumnRenamed("node", "a"), "a", "left").select(F.col("b").alias("node"), F.coalesce("component", "a").alias("component"))
    found = classes.unionByName(copied).groupBy("node").agg(F.min("component").alias("component"))
    out = docs.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of smallest doc_id; other columns pass through.

    Rows with null doc_id take part under keys made from their texts, above all ids, so such a row stays
    only if its class has no other; of rows that repeat a doc_id, or a text without one, the first
    by the text's hash stays.
    """
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), made).alias("doc_id"), "text")
    gone = near_duplicates(keyed.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    left = keyed.join(gone, "doc_id", "left_anti")
    again = stash(keyed.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not again.isEmpty():
        first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        once = left.join(again, "doc_id", "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
        left = left.join(again, "doc_id", "left_anti").unionByName(once)
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
