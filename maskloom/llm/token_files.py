"""Token-id files: independent zstandard frames, a doc index, and a trailing seek table.

Layout of a file: data frames (little-endian uint32 ids of whole documents), one index frame
(document ids, null marks and token offsets), then a skippable frame in the public zstandard
seekable format: per frame its compressed size, its size and the low 32 bits of its XXH64;
footer: number of frames, descriptor byte (bit 7: checksums), magic number. A reader opens the
end, checks and decompresses the index frame and then only the frames of requested documents.

Cases: null text is empty; every document gets the end id, so none has zero tokens; repeated
and null ``doc_id`` rows are all written, nulls first; an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import partitions
from maskloom.llm.store import open_input, replacing
from maskloom.llm.wordcache import cached_tokenizer

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "path string, first_id long, first_key long, docs long, tokens long, bytes long"


class TokenFileWriter:
    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.table: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.tokens = self.written = 0

    def add(self, doc_id: int | None, payload: bytes) -> None:
        self.ids.append(doc_id)
        self.tokens += len(payload) // 4
        self.ends.append(self.tokens)
        self.pending.append(payload)
        self.pending_bytes += len(payload)
        if self.pending_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.pending_bytes = [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._put(packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> None:
        self._flush()
        null = np.array([i is None for i in self.ids], "u1")
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.ends, "<u8").tobytes())
        body = b"".join(struct.pack("<III", *entry) for entry in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class TokenFileReader:
    def __init__(self, file):
        self.file = file
        end = file.size() if hasattr(file, "size") and callable(file.size) else file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable token file with checksums")
        raw = self._at(end - 9 - 12 * n, 12 * n)
        self.table = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.at = np.concatenate([[0], np.cumsum([e[0] for e in self.table])]).tolist()
        self.raw_at = np.concatenate([[0], np.cumsum([e[1] for e in self.table[:-1]])]).tolist()
        self.unpack = zstandard.ZstdDecompressor().decompress
        index = self.frame(n - 1)
        (docs,) = struct.unpack_from("<Q", index)
        self.null = np.frombuffer(index, "u1", docs, 8 + 8 * docs)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8)
        self.ends = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).astype("i8")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        size, raw_size, check = self.table[i]
        raw = self.unpack(self._at(self.at[i], size), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first token, ids) in file order; only frames that hold a wanted document are decompressed."""
        held, data = -1, b""
        for k, end in enumerate(self.ends.tolist()):
            doc = None if self.null[k] else int(self.doc_ids[k])
            if wanted is not None and doc not in wanted:
                continue
            start = int(self.ends[k - 1]) if k else 0
            i = bisect_right(self.raw_at, 4 * start) - 1
            if i != held:
                held, data = i, self.frame(i)
            yield doc, start, data[4 * start - self.raw_at[i] : 4 * end - self.raw_at[i]]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, frame_bytes: int = 1 << 18, file_bytes: tuple[int, int] = (4 << 20, 256 << 20)) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file per range of doc_id under ``path``, in ascending order.

    There are as many files as shuffle partitions, but more or fewer where a file would stand for texts
    of less or more than ``file_bytes`` on average.
    Returns the manifest, one row per file. Rows with one doc_id are ordered by a hash of the text,
    which also splits a very frequent doc_id. A task that runs again replaces its file by an equal one.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        lead, key = first["doc_id"][0].as_py(), first["key"][0].as_py()
        encoder = cached_tokenizer(definition.value, spaces=True)
        tail = np.array([end_id], "<u4").tobytes()
        name = f"{path}/tokens-{TaskContext.get().partitionId():06d}.zst"
        with replacing(name) as out:
            writer = TokenFileWriter(out, frame_bytes)
            batch = first
            while batch is not None:
                for doc, payload in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                    writer.add(doc, payload + tail)
                batch = next(batches, None)
            writer.close()
        row = [name, lead, key, len(writer.ids), writer.tokens, writer.written]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string()] + [pa.int64()] * 5)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = min(max(partitions(spark), -(-size // file_bytes[1])), size // file_bytes[0] + 1)
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    done = dealt.mapInArrow(write, MANIFEST).collect()  # a row per file
    done.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_key))
    return spark.createDataFrame(done, MANIFEST)


def read_token_files(spark: SparkSession, manifest: DataFrame, wanted: Iterable[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it over all files), n_tokens, ids_crc32, and ids (binary) if asked for."""
    files = manifest.collect()
    base, jobs = 0, []
    for f in files:
        jobs.append((f.path, base))
        base += f.tokens
    wanted = None if wanted is None else set(wanted)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                with open_input(path) as f:
                    rows, held = [], 0
                    for doc, start, ids in TokenFileReader(f).documents(wanted):
                        rows.append((doc, before + start, len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids))
                        held += len(ids)
                        if held > 1 << 23:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    jobs_df = spark.createDataFrame(jobs, "path string, before long")
    if jobs:
        jobs_df = jobs_df.repartitionByRange(len(jobs), "before")
    return jobs_df.mapInPandas(read, schema)
