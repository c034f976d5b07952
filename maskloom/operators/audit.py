"""Receipts, period reports with k-anonymity, and incremental ingest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskloom.functions.text import QUASI, hmac_hex, pads

PERIODS = {"hourly": 3600, "daily": 86_400, "weekly": 604_800}


def receipts(requests: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row per request: findings by kind (a JSON object, kinds in order) and quasi-identifier flags."""
    quasi = F.col("kind").isin(*QUASI)
    by = found.groupBy(key, "kind").agg(F.count("*").alias("n"))
    cells = F.array_sort(F.collect_list(F.when(~quasi, F.struct("kind", "n"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), c["kind"], F.lit('":'), c["n"].cast("string"))), ","), F.lit("}"))
    per = by.groupBy(key).agg(text.alias("masked_by_type"), F.coalesce(F.sum(F.when(quasi, F.col("n"))), F.lit(0)).alias("quasi_id_flags"))
    out = requests.select(key).distinct().join(per, key, "left")
    return out.select(key, F.coalesce("masked_by_type", F.lit("{}")).alias("masked_by_type"), F.coalesce("quasi_id_flags", F.lit(0)).cast("long").alias("quasi_id_flags"))


def full_receipts(requests: DataFrame, found: DataFrame, answers: DataFrame, key: str, policy: dict, version: str = "1") -> DataFrame:
    """One receipt for each row of ``requests`` (key, tenant_id, session_ref_hashed, ts_unix), as the ledger stores them.

    ``found`` (key, kind) are the findings of the request, ``answers`` (key, incomplete_restorations,
    blocked_outputs) the sentinels left in the response. No text enters a receipt.
    """
    quasi = F.col("kind").isin(*QUASI)
    by = found.groupBy(key, "kind").agg(F.count("*").alias("n"))
    per = by.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~quasi, F.struct("kind", "n"))))).alias("masked_by_type"),
        F.coalesce(F.sum(F.when(quasi, F.col("n"))), F.lit(0)).alias("quasi_id_flags"),
    )
    left = answers.groupBy(key).agg(F.sum("incomplete_restorations").alias("incomplete_restorations"), F.sum("blocked_outputs").alias("blocked_outputs"))
    rows = requests.join(per, key, "left").join(left, key, "left")
    none = F.create_map().cast("map<string,bigint>")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("quasi_id_flags", "incomplete_restorations", "blocked_outputs")]
    counters = F.struct(F.coalesce("masked_by_type", none).alias("masked_by_type"), *counts)
    return rows.select(
        key, "tenant_id", "session_ref_hashed", F.col("ts_unix").cast("long").alias("ts_unix"), F.lit(version).alias("engine_version"),
        F.lit(policy_hash(policy)).alias("policy_hash"), counters.alias("counters"),
    )


def policy_hash(policy: dict) -> str:
    """SHA-256 of the policy's JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


FIELDS = ["tenant_id", "session_ref_hashed", "ts_unix", "engine_version", "policy_hash", "counters"]


def canonical(*fields: str) -> Column:
    """The receipt's JSON: its fields in a fixed order, kinds in order of name."""
    counters = F.col("counters").withField("masked_by_type", F.map_from_entries(F.array_sort(F.map_entries("counters.masked_by_type"))))
    return F.to_json(F.struct(*[counters.alias("counters") if c == "counters" else F.col(c) for c in fields or FIELDS]))


def seal(receipt: Column, ipad: Column, opad: Column) -> Column:
    """Symmetric seal of a receipt: tamper-evident to holders of the key only."""
    return hmac_hex(receipt, ipad, opad)


def sealed(receipts: DataFrame, secret: bytes) -> DataFrame:
    """``receipts`` with their seal as ``sig_agent``."""
    one = F.broadcast(pads(receipts.sparkSession, secret))  # one row
    return receipts.crossJoin(one).withColumn("sig_agent", seal(canonical(), F.col("ipad"), F.col("opad"))).drop("ipad", "opad")


def verified(receipts: DataFrame, secret: bytes) -> DataFrame:
    """``receipts`` with ``valid``: whether ``sig_agent`` is the seal of the row as it is (none: not)."""
    one = F.broadcast(pads(receipts.sparkSession, secret))
    return receipts.crossJoin(one).withColumn("valid", F.coalesce(F.col("sig_agent") == seal(canonical(), F.col("ipad"), F.col("opad")), F.lit(False))).drop("ipad", "opad")


def in_period(ts: Column, period: str, now: int) -> Column:
    """Rolling [now - width, now + 1); ``all`` takes everything."""
    if period == "all":
        return F.lit(True)
    if period not in PERIODS:
        raise ValueError(f"unknown period {period}")
    return (ts >= now - PERIODS[period]) & (ts < now + 1)


def period_report(receipts: DataFrame, period: str, now: int, k: int) -> DataFrame:
    """One row (period, period_start, period_end, total_requests, redacted, publishable) over receipts (ts_unix, counters).

    Bounds are those of the period, for ``all`` those of the receipts (from 0 without any). Cells are
    sums by kind, and 0 below ``k``; a report is publishable if it has cells and none is below.
    """
    if k < 2:
        raise ValueError("k is at least 2")
    rows = receipts.filter(in_period(F.col("ts_unix"), period, now))
    cells = rows.select(F.explode("counters.masked_by_type").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))
    shown = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.when(F.col("n") >= k, F.col("n")).otherwise(0).cast("long").alias("n")))))
    redacted = cells.agg(shown.alias("redacted"), F.coalesce(F.bool_and(F.col("n") >= k), F.lit(False)).alias("publishable"))
    whole = rows.agg(F.count("*").alias("total_requests"), F.min("ts_unix").alias("lo"), F.max("ts_unix").alias("hi"))
    start = F.coalesce("lo", F.lit(0)) if period == "all" else F.lit(now - PERIODS[period])
    end = F.coalesce(F.col("hi") + 1, F.lit(now + 1)) if period == "all" else F.lit(now + 1)
    return whole.crossJoin(F.broadcast(redacted)).select(F.lit(period).alias("period"), start.cast("long").alias("period_start"), end.cast("long").alias("period_end"), "total_requests", "redacted", "publishable")  # one row each


def k_anonymous(cells: DataFrame, k: int, *by: str) -> DataFrame:
    """Cells (by..., kind, n): those below ``k`` show 0; a report is publishable if it has cells and none is below."""
    if k < 2:
        raise ValueError("k is at least 2")
    all_of = W.partitionBy(*by)
    return cells.select(*by, "kind", F.when(F.col("n") >= k, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"), F.min(F.col("n") >= k).over(all_of).alias("publishable"))


def runs(rows: DataFrame, tenant: str, order: list[str], partition: list[str]) -> DataFrame:
    """``rows`` numbered by runs of consecutive equal tenants: A, B, A are three runs."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(tenant).eqNullSafe(F.lag(tenant).over(w)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def pending(ledger: DataFrame, cursor: int, limit: int = 512) -> DataFrame:
    """The next ``limit`` receipts (seq from 0) after the cursor."""
    return ledger.filter(F.col("seq") >= max(cursor, 0)).orderBy("seq").limit(limit)


def flushed_prefix(groups: DataFrame, partition: list[str]) -> DataFrame:
    """Groups (run, ok) before the first failure; they are what a flush may commit."""
    w = W.partitionBy(*partition).orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)
    return groups.withColumn("sent", F.min(F.col("ok").cast("int")).over(w) == 1)


def recovered_cursor(cursor: Column, length: Column) -> Column:
    """A stored cursor read back: 0 if it is no number, at most the ledger's length."""
    return F.least(F.greatest(F.coalesce(cursor.try_cast("long"), F.lit(0)), F.lit(0)), length)
