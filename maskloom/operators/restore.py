"""Restoration of sentinels through the request's registry; anything else fails loudly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import CLOSE, MIDDLE, OPEN, SENTINEL, WELL_FORMED, let
from maskloom.operators.fields import response_fields, with_response_texts

MARKER = "[REDACTED]"
BARE = "[a-z2-7]+"


def restore(df: DataFrame, registry: DataFrame, key: str, text: str = "text", marker: str = MARKER) -> DataFrame:
    """(key, text, restored, unresolved) per row of ``df`` (one field per key).

    A sentinel is replaced if this request emitted it. If any other sentinel, or one cut short, is
    left, the whole field becomes ``marker``. The registry is joined by (request, token), of repeated
    rows the largest value counts, and its hits per field are no more than the field's tokens. Null
    text stays null and restores nothing.
    """
    fields = df.select(key, text, F.regexp_extract_all(text, F.lit(SENTINEL), F.lit(0)).alias("toks"), F.split(text, SENTINEL, -1).alias("segs"))
    # a field without a sentinel needs no join
    asked = fields.filter(F.size("toks") > 0).select(key, F.explode(F.array_distinct("toks")).alias("token"))
    hits = asked.join(registry.select(F.col("request_id").alias(key), "token", "value"), [key, "token"])
    hits = hits.groupBy(key, "token").agg(F.max("value").alias("value"))
    book = hits.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("book"))
    joined = fields.join(book, key, "left")
    value = F.transform("toks", lambda t: F.try_element_at(F.col("book"), t))
    put = let(value, lambda vs: F.transform("segs", lambda s, i: F.concat(s, F.coalesce(F.get(vs, i), F.lit("")))))
    value = F.coalesce(value, F.array().cast("array<string>"))
    missing = F.size(F.filter(value, lambda v: v.isNull()))
    cut = F.size(F.filter("segs", lambda s: F.contains(s, F.lit(OPEN)) | F.contains(s, F.lit(CLOSE))))
    counted = joined.withColumns({"missing": F.when(F.size("toks") > 0, missing).otherwise(0), "broken": F.coalesce(cut, F.lit(0))})
    bad = F.col("missing") + F.col("broken")
    out = F.when(F.col(text).isNull(), None).when(bad > 0, F.lit(marker)).otherwise(F.array_join(put, ""))
    return counted.select(key, out.alias(text), F.coalesce(F.size("toks") - F.col("missing"), F.lit(0)).cast("long").alias("restored"), bad.cast("long").alias("unresolved"))


def wrap_bare(df: DataFrame, registry: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Put brackets back around bodies that a model returned bare: whole runs of 26 body characters in the registry."""
    body = F.regexp_extract("token", f"{OPEN}([a-z2-7]*)", 1)
    once = registry.groupBy(F.col("request_id").alias(key), body.alias("body")).agg(F.min("token").alias("token"))
    book = once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("body", "token"))).alias("book"))
    inside = f"{OPEN}[^{CLOSE}]*{CLOSE}|{BARE}"
    runs = F.regexp_extract_all(text, F.lit(inside), F.lit(0))
    segs = F.split(text, inside, -1)
    back = F.transform(runs, lambda r: F.when(F.length(r) == 26, F.coalesce(F.try_element_at(F.col("book"), r), r)).otherwise(r))
    out = F.array_join(let(back, lambda bs: F.transform(segs, lambda s, i: F.concat(s, F.coalesce(F.get(bs, i), F.lit(""))))), "")
    joined = df.join(book, key, "left")
    return joined.withColumn(text, F.when(F.col("book").isNull() | F.col(text).isNull(), F.col(text)).otherwise(out)).drop("book")


def sentinel_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Well-formed sentinels left in a response (restoration incomplete) and malformed ones (output blocked)."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SENTINEL), F.lit(0))
    good = F.size(F.filter(found, lambda t: t.rlike(WELL_FORMED)))
    return df.select(key, good.cast("long").alias("incomplete_restorations"), (F.size(found) - good).cast("long").alias("blocked_outputs"))


def restore_leaves(leaves: DataFrame, registry: DataFrame, request: str, at: list[str], marker: str = MARKER, bare: bool = True) -> DataFrame:
    """``leaves`` (request, columns ``at``, text) restored field by field, with their counts: fields of one request share its registry."""
    one = leaves.withColumn("_field", F.struct(request, *at))
    tokens = registry.select(F.col("request_id").alias(request), "token", "kind", "value")
    asked = one.select("_field", request).join(tokens, request).select(F.col("_field").alias("request_id"), "token", "kind", "value")
    fields = one.select("_field", "text")
    done = restore(wrap_bare(fields, asked, "_field") if bare else fields, asked, "_field", marker=marker)
    return done.select(F.col("_field")[request].alias(request), *[F.col("_field")[c].alias(c) for c in at], "text", "restored", "unresolved")


def restore_responses(bodies: DataFrame, registry: DataFrame, request: str, body: str = "body", marker: str = MARKER) -> DataFrame:
    """(request, body, restored, unresolved): every text leaf of chat or legacy responses restored in place.

    A body of another shape passes as it is. One row for each request is expected.
    """
    done = restore_leaves(response_fields(bodies, request, body), registry, request, ["choice", "channel", "idx"], marker)
    name = F.concat_ws("/", "choice", "channel", "idx")
    totals = done.groupBy(request).agg(F.map_from_entries(F.collect_list(F.struct(name, "text"))).alias("texts"), F.sum("restored").alias("restored"), F.sum("unresolved").alias("unresolved"))
    joined = bodies.join(totals, request, "left")
    new = F.when(F.col("texts").isNull(), F.col(body)).otherwise(with_response_texts(F.col(body), F.col("texts")))
    return joined.select(request, F.coalesce(new, F.col(body)).alias(body), F.coalesce("restored", F.lit(0)).alias("restored"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


__all__ = ["MARKER", "restore_leaves", "restore_responses", "MIDDLE", "restore", "sentinel_counts", "wrap_bare"]
