"""Keys, digests, cached verification, version purge, tenants seen, and call policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def composite_key(header: Column) -> tuple[Column, Column, Column]:
    """(valid, access token, upstream key) of ``Bearer mn_<token>.<upstream>``, split at the first dot."""
    rest = F.when(F.lower(F.substr(header, F.lit(1), F.lit(7))) == "bearer ", F.trim(F.substr(header, F.lit(8))))
    dot = F.instr(rest, ".")
    token, upstream = F.substr(rest, F.lit(1), dot - 1), F.substr(rest, dot + 1)
    valid = F.coalesce(rest.startswith("mn_") & (dot > 0) & (F.length(token) > 3) & (F.length(upstream) > 0), F.lit(False))
    return valid, F.when(valid, token), F.when(valid, upstream)


def tenant_of(name: Column, default: str = "default") -> Column:
    """A trimmed name of 1 to 64 of A-Z a-z 0-9 . _ -, else the default tenant."""
    trimmed = F.trim(name)
    return F.when(trimmed.rlike("^[A-Za-z0-9._-]{1,64}$"), trimmed).otherwise(F.lit(default))


def digest(domain: str, token: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain), token).cast("binary"), 256)


def cached(events: DataFrame, key: str, ts: str, decision: Column, ttl: int, order: list[str]) -> DataFrame:
    """Each event with the latest earlier decision of its key, if it is at most ``ttl`` seconds old."""
    w = W.partitionBy(key).orderBy(ts, *order).rowsBetween(W.unboundedPreceding, -1)
    at = F.last(F.when(decision, F.unix_seconds(F.col(ts))), ignorenulls=True).over(w)
    age = F.unix_seconds(F.col(ts)) - at
    return events.withColumn("age", age).withColumn("fresh", F.coalesce(age <= ttl, F.lit(False)))


def purges(events: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """Events at which the tenant's version differs, in any direction, from the one before."""
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag(version).over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col(version)))


def seen_tenants(events: DataFrame, tenant: str, ts: str, keep: int = 64, default: str = "default") -> DataFrame:
    """The ``keep`` tenants that were first seen last, the default one left out."""
    first = events.filter(F.col(tenant).isNotNull() & (F.col(tenant).cast("string") != default)).groupBy(tenant).agg(F.min(ts).alias("first_seen"))
    return first.orderBy(F.desc("first_seen"), F.desc(tenant)).limit(keep)


def retryable(status: Column, body: Column) -> Column:
    """502 and 503, or success with a body that is no JSON."""
    json = F.try_parse_json(body).isNotNull()
    return status.isin(502, 503) | (status.between(200, 299) & ~json)


def join_url(base: Column, path: str) -> Column:
    """``path`` (without /v1) under ``base``, with one /v1 in between."""
    clean = F.regexp_replace(base, "/+$", "")
    return F.concat(F.when(clean.endswith("/v1"), clean).otherwise(F.concat(clean, F.lit("/v1"))), F.lit(path))


def session_ref(tenant: Column, token: Column, domain: str = "session:") -> Column:
    """64 hex digits that are stable for a tenant's access token and tell neither; null for null."""
    return F.sha2(F.concat(F.lit(domain), tenant, F.lit("\x1f"), token).cast("binary"), 256)


def live_decisions(decisions: DataFrame, polls: DataFrame, ttl: int, now: int) -> DataFrame:
    """Cached ``decisions`` (tenant, digest, valid, at) that still hold at ``now``: not older than ``ttl`` seconds
    and made at or after the tenant's last change of version, in any direction, in ``polls`` (tenant, version, at)."""
    w = W.partitionBy("tenant").orderBy("at", "version")
    changes = polls.filter(F.col("at") <= now).withColumn("before", F.lag("version").over(w)).filter(F.col("before") != F.col("version"))
    last = changes.groupBy("tenant").agg(F.max("at").alias("purged"))
    fresh = decisions.filter((F.col("at") <= now) & (now - F.col("at") <= ttl))
    return fresh.join(last, "tenant", "left").filter(F.col("purged").isNull() | (F.col("at") >= F.col("purged"))).drop("purged")


def accepted(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """``requests`` (tenant, digest, ...) with ``accepted``: a token is good in the tenant that verified it, nowhere else."""
    known = decisions.groupBy("tenant", "digest").agg(F.max_by("valid", "at").alias("_valid"))
    return requests.join(known, ["tenant", "digest"], "left").withColumn("accepted", F.coalesce("_valid", F.lit(False))).drop("_valid")
