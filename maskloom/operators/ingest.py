"""Incremental ingest of a ledger: pending receipts go out in runs of one tenant, and a durable cursor follows what was sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.audit import pending, runs

#: Receipts of one flush.
BATCH = 512


class Cursor:
    """A number in a file of a store that Spark can write, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.part, self.io = jvm.org.apache.hadoop.fs.Path(path + ".tmp"), jvm.org.apache.commons.io.IOUtils

    def read(self, length: int) -> int:
        """The stored number, 0 if there is none or it is no number, and at most ``length``."""
        if not self.files.exists(self.path):
            return 0
        stream = self.files.open(self.path)
        try:
            text = self.io.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        return min(max(int(text), 0), length) if text.lstrip("+-").isdigit() else 0

    def write(self, value: int) -> None:
        stream = self.files.create(self.part, True)
        stream.write(bytearray(str(value).encode()))
        stream.close()
        if self.files.exists(self.path):
            self.files.delete(self.path, False)
        self.files.rename(self.part, self.path)


def batches(waiting: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """(run, tenant_id, n, period_start, period_end) of consecutive receipts (seq, ts_unix) of one tenant, in order."""
    numbered = runs(waiting.withColumn("_one", F.lit(1)), tenant, ["seq"], ["_one"])  # a flush of BATCH receipts at most
    return numbered.groupBy("run").agg(F.min(tenant).alias(tenant), F.count("*").alias("n"), F.min("ts_unix").alias("period_start"), (F.max("ts_unix") + 1).alias("period_end"), F.array_sort(F.collect_list(F.struct("seq", F.struct("*").alias("receipt")))).alias("rows"))


def flush(ledger: DataFrame, cursor: Cursor, send: Callable[[Row], bool], limit: int = BATCH) -> int:
    """Send the next ``limit`` receipts of ``ledger`` (seq from 0, tenant_id, ts_unix, ...) in order of their runs.

    Stops at the first run that ``send`` refuses or fails on, and moves the cursor behind those sent
    before it. Returns how many receipts went out.
    """
    length = ledger.count()
    at, sent = cursor.read(length), 0
    for run in sorted(batches(pending(ledger, at, limit)).collect(), key=lambda r: r.run):  # ``limit`` receipts at most
        try:
            ok = send(run)
        except Exception:  # what a sender raises is a refusal
            ok = False
        if not ok:
            break
        sent += run.n
    if sent:
        cursor.write(min(at + sent, length))
    return sent


def flush_forever(rows: DataFrame, ledger: Callable[[], DataFrame], cursor: Cursor, send: Callable[[Row], bool], checkpoint: str, every: str = "60 seconds", limit: int = BATCH, once: bool = False):
    """A query that flushes at each trigger of the stream ``rows``, until nothing is pending or a run fails."""

    def step(_batch: DataFrame, _id: int) -> None:
        while flush(ledger(), cursor, send, limit) == limit:
            pass

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
