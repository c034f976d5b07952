"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

A gene is a bin. Crossover injects whole well-filled bins of one parent into the other, drops
the receiver's bins that hold any of their pieces, and puts the displaced pieces back by best
fit, longest first. Pieces are dealt by a hash into shards of bounded size; each shard evolves on
several islands that begin with packings of random order and keep their populations; the best
packing of each goes to the next island of a ring between epochs. A shard whose packing has the
least possible number of bins is done.

Cases: null text is empty (one end id); a piece of the full length fills a bin of its own; rows
repeated or with null ``doc_id`` are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import ratio_parts, stash
from maskloom.llm.wordcache import cached_tokenizer

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, place long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_tokenizer(definition.value, spaces=False)
        tail = np.array([end_id], "<u4").tobytes()
        place = 0
        for batch in batches:
            rows = []
            for doc, payload in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                payload += tail
                for piece, at in enumerate(range(0, len(payload), 4 * capacity)):
                    part = payload[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), place))
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, PIECE_TYPES)], names=PIECE_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, PIECES)


def best_fit(sizes, items, bins: list[list[int]], loads: list[int], capacity: int) -> None:
    """Put ``items``, in their order, each into the fullest bin that takes it."""
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            loads[b] += sizes[i]
            free -= sizes[i]
        else:
            b, free = len(bins), capacity - sizes[i]
            bins.append([i])
            loads.append(sizes[i])
        if free:
            insort(room, (free, b))


def fitness(loads: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller ones fuller."""
    return len(loads), -sum((x / capacity) ** 2 for x in loads)


def numbered(bins: list[list[int]], items: int) -> bytes:
    """A packing as each item's bin number, int32."""
    out = np.empty(items, "<i4")
    for b, members in enumerate(bins):
        out[members] = b
    return out.tobytes()


def listed(packed: bytes) -> list[list[int]]:
    """The bins of a packing written by ``numbered``."""
    of = np.frombuffer(packed, "<i4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


class Island:
    """A population of packings of one shard; ``bins`` lists item numbers. It begins with packings of
    items in random order, so that its bins come from crossover."""

    def __init__(self, sizes: list[int], capacity: int, seed: int, size: int = 4, people: list | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-sum(sizes) // capacity)
        self.crossed = 0
        self.people = [self._rated(bins) for bins in people or []]
        while len(self.people) < size:
            bins, loads = [], []
            best_fit(sizes, self.rng.permutation(len(sizes)).tolist(), bins, loads, capacity)
            self.people.append((fitness(loads, capacity), bins, loads))

    def _rated(self, bins):
        loads = [sum([self.sizes[i] for i in b]) for b in bins]
        return fitness(loads, self.capacity), bins, loads

    def done(self) -> bool:
        """Whether a packing has the least possible number of bins."""
        return self.best()[0][0] <= self.least

    def best(self):
        return min(self.people, key=lambda p: p[0])

    def _cross(self, giver, taker):
        """Whole bins of ``giver``, fuller ones likelier, enter ``taker``, whose bins with any of their pieces
        open, as do its emptiest ones; the displaced pieces are put back by best fit, longest first."""
        sizes, capacity = self.sizes, self.capacity
        _, bins, loads = giver
        odds = np.array([(x / capacity) ** 4 + 1e-9 for x in loads])
        taken = self.rng.choice(len(bins), max(1, len(bins) // 4), replace=False, p=odds / odds.sum())
        injected = [list(bins[k]) for k in taken]
        moved = {i for b in injected for i in b}
        _, bins, loads = taker
        emptiest = set(np.argsort(loads)[: max(1, len(bins) // int(self.rng.choice([2, 4, 8])))].tolist())
        stays = [k for k, b in enumerate(bins) if k not in emptiest and moved.isdisjoint(b)]
        kept = [list(bins[k]) for k in stays] + injected
        there = moved.union(*[bins[k] for k in stays])
        loose = sorted((i for i in range(len(sizes)) if i not in there), key=lambda i: (-sizes[i], i))
        kept_loads = [loads[k] for k in stays] + [sum([sizes[i] for i in b]) for b in injected]
        best_fit(sizes, loose, kept, kept_loads, capacity)
        self.crossed += 1
        return fitness(kept_loads, capacity), kept, kept_loads

    def evolve(self, generations: int) -> None:
        """Children of the best and another replace the worst, for ``generations`` or until done."""
        for _ in range(generations):
            if self.done() or len(self.people) < 2:
                return
            first = min(range(len(self.people)), key=lambda k: self.people[k][0])
            other = int(self.rng.choice([k for k in range(len(self.people)) if k != first]))
            giver, taker = (first, other) if self.rng.random() < 0.5 else (other, first)
            child = self._cross(self.people[giver], self.people[taker])
            worst = max(range(len(self.people)), key=lambda k: self.people[k][0])
            if child[0] < self.people[worst][0]:
                self.people[worst] = child

    def settle(self, migrant: list[list[int]]) -> None:
        """Take a packing from elsewhere in place of the worst."""
        worst = max(range(len(self.people)), key=lambda k: self.people[k][0])
        self.people[worst] = self._rated(migrant)


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    shard_pieces: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    generations: int = 12,
) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (any columns, with ``length`` from 1 to ``capacity`` and ``place``).

    ``place`` tells repeated rows apart, so that they spread over the shards like other rows.
    """
    pieces = stash(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    shards = ratio_parts(pieces.count(), shard_pieces)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("part", "place", "ids_crc32"), F.lit(shards)).cast("int"))
    return assign(evolve_shards(pieces, capacity, islands, epochs, generations), capacity)


def evolve_shards(pieces: DataFrame, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """One row per shard: its pieces' keys, each island's best packing, and the crossovers of the last epoch."""
    order = ["part", "place"]
    keys = pieces.groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct(*order, "doc_id", "piece", "start", "length", "ids_crc32"))).alias("items")
    )
    nobody = F.lit(None).cast("array<binary>")
    state = keys.select("shard", "items", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), nobody.alias("people"), F.lit(None).cast("binary").alias("migrant"))

    def epoch(number: int):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                people, crossed = [], []
                for items, own, migrant, shard, island in zip(*[batch[c] for c in ("items", "people", "migrant", "shard", "island")]):
                    sizes = [int(x["length"]) for x in items]
                    there = Island(sizes, capacity, (int(shard) * 31 + int(island)) * 31 + number, people=None if own is None else [listed(p) for p in own])
                    if migrant is not None:
                        there.settle(listed(migrant))
                    there.evolve(generations)
                    people.append([numbered(p[1], len(sizes)) for p in sorted(there.people, key=lambda p: p[0])])
                    crossed.append(there.crossed)
                yield batch.assign(people=people, crossed=crossed)

        return run

    for number in range(epochs):
        evolved = state.repartition("shard", "island").mapInPandas(epoch(number), "shard int, items " + state.schema["items"].dataType.simpleString() + ", island int, people array<binary>, migrant binary, crossed int")
        folk = F.array_sort(F.collect_list(F.struct("island", "people", "crossed")))  # a row for each island
        met = evolved.groupBy("shard").agg(F.first("items").alias("items"), folk.alias("folk"))
        if number + 1 < epochs:  # the best of each island goes to the next one of the ring; populations stay
            each = met.select("shard", "items", "folk", F.explode("folk").alias("f"))
            before = F.element_at("folk", (F.pmod(F.col("f.island") - 1, F.lit(islands)) + 1).cast("int"))
            migrant = F.when(F.lit(islands > 1), F.get(before["people"], 0))
            state = each.select("shard", "items", F.col("f.island").alias("island"), F.col("f.people").alias("people"), migrant.alias("migrant"))
    return met.select("shard", "items", F.transform("folk", lambda x: F.get(x["people"], 0)).alias("best"), F.aggregate("folk", F.lit(0), lambda n, x: n + x["crossed"]).alias("crossed"))


def assign(shards: DataFrame, capacity: int) -> DataFrame:
    """The pieces of every shard at their places in the packing of fewest bins."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, items, best in zip(batch["shard"], batch["items"], batch["best"]):
                for b, members in enumerate(min([listed(p) for p in best], key=len)):
                    at = 0
                    for i in members:
                        x = items[i]
                        out.append((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], (int(shard) << 32) + b, at))
                        at += x["length"]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return shards.mapInPandas(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    return pack(encode_pieces(docs, tokenizer, capacity), capacity)
