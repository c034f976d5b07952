"""The receipt ledger: JSON lines, read leniently and appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = "tenant_id string, session_ref_hashed string, ts_unix bigint, engine_version string, policy_hash string, counters struct<masked_by_type:map<string,bigint>,quasi_id_flags:bigint,incomplete_restorations:bigint,blocked_outputs:bigint>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Receipts of a ledger; blank and corrupt lines, and those without a tenant or time, are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", RECEIPT)).alias("r"))
    return rows.filter("r.tenant_id IS NOT NULL AND r.ts_unix IS NOT NULL").select("r.*")


def append_ledger(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)
