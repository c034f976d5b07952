"""Helpers shared by the corpus operators: shared storage, lineage cuts, keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as
    a machine's own folder can't be read by the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # a path without a scheme lies in Spark's default file system
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", files.makeQualified(path).toString()).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [discard(*x) for x in _made])
    _made.append((spark, at))
    return at


_made: list[tuple[SparkSession, str]] = []


def discard(spark: SparkSession, at: str) -> None:
    """Delete what was written at a fresh path, if the session still runs."""
    if spark.sparkContext._jsc is None:
        return
    with suppress(Exception):  # leftovers harm nothing
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors and is smaller than a row checkpoint.
    """
    spark = df.sparkSession
    at = fresh_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(schema).parquet(at)


#: Bytes of a table that may be broadcast.
SMALL = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast only while its rows of about ``row_bytes`` bytes come to SMALL bytes at most."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text modulo ``modulus``; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ratio_parts(n: int, size: int) -> int:
    """How many parts of about ``size`` rows hold ``n`` rows."""
    return max(1, -(-n // size))
