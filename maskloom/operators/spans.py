"""Span algebra: overlapping windows, BIO islands, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def windows(length: Column, longest: int = 511, overlap: int = 64) -> Column:
    """Array of (start, end) that cover [0, length); none for an empty input."""
    if longest <= overlap:
        raise ValueError("a window must be longer than the overlap")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(length.cast("long") - overlap - 1, F.lit(0)), F.lit(longest - overlap).cast("long"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + longest, length.cast("long")).alias("end")))
    return F.when(length > 0, cut).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def bio_islands(tokens: DataFrame, key: str, threshold: float = 0.70) -> DataFrame:
    """Spans from labelled tokens (key, pos, start, end, label, prob): neighbours of one kind that touch merge.

    Labels in any case lose a B-, I-, E- or S- prefix; PER and PERSON are Person; LOC, LOCATION and GPE are
    Location; others and tokens of empty extent end a span. The mean probability must reach ``threshold``.
    """
    bare = F.regexp_replace(F.upper("label"), "^[BIES]-", "")
    kind = F.when(bare.isin("PER", "PERSON"), "Person").when(bare.isin("LOC", "LOCATION", "GPE"), "Location")
    t = tokens.withColumn("kind", F.when(F.col("end") > F.col("start"), kind))
    order = W.partitionBy(key).orderBy("pos")
    joins = F.col("kind").eqNullSafe(F.lag("kind").over(order)) & F.col("start").eqNullSafe(F.lag("end").over(order))
    t = t.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = t.filter(F.col("kind").isNotNull()).groupBy(key, "island", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("prob").alias("score"))
    return spans.filter(F.col("score") >= threshold).drop("island")


def drop_contained(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, kind, start, end) without those inside an earlier kept one of the same kind, repeats included."""
    order = W.partitionBy(key, "kind").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(order)).filter(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).drop("reach")


def enclosing_wins(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Spans of ``outer`` and those of ``inner`` that lie in none of them."""
    o = outer.select(F.col(key).alias("k"), F.col("start").alias("os"), F.col("end").alias("oe"))
    inside = (F.col(key) == F.col("k")) & (F.col("start") >= F.col("os")) & (F.col("end") <= F.col("oe"))
    return outer.unionByName(inner.join(o, inside, "left_anti"))


def best_label(logits: Column) -> tuple[Column, Column]:
    """(place of the largest logit from 0, its stable softmax probability); null for null or empty logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return (F.array_position(logits, top) - 1).cast("int"), F.when(F.size(logits) > 0, 1 / total)


def known_kinds(spans: DataFrame, text_length: str, kinds: tuple[str, ...] = ("PERSON", "LOC")) -> DataFrame:
    """Spans of an outside producer that can be used: of ``kinds``, not empty, inside their text."""
    return spans.filter(F.col("kind").isin(*kinds) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col(text_length)))
