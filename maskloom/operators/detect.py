"""Detection, masking and generalisation of personal data in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.text import PLACES, QUASI, fake, kind_of, label, let, pads, pattern, placed, sentinel


def matches(text: Column, disabled: list[str] | None = None) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(disabled)), F.lit(0))


def segments(text: Column, disabled: list[str] | None = None) -> Column:
    """The text between the matches."""
    return F.split(F.coalesce(text, F.lit("")), pattern(disabled), -1)


def detect(df: DataFrame, key: str, text: str = "text", disabled: list[str] | None = None) -> DataFrame:
    """One row per valid finding: key, kind, value, and its place in characters and UTF-8 bytes.

    Null and empty texts have no findings. Places are running sums of segment lengths.
    """
    found = df.select(F.col(key).alias("_key"), F.inline(placed(F.col(text), pattern(disabled))))
    rows = found.withColumn("kind", kind_of(F.col("value"), disabled)).filter(F.col("kind").isNotNull())
    return rows.select(F.col("_key").alias(key), "kind", "value", "start", (F.col("start") + F.length("value")).alias("end"), "byte_start")


def mask(df: DataFrame, secret: bytes, text: str = "text", fakes: bool = False, disabled: list[str] | None = None) -> DataFrame:
    """``df`` with ``text`` masked in one pass: identifiers become sentinels, quasi-identifiers labels.

    With ``fakes``, kinds that have a realistic stand-in get it, which can't be restored.

    Values that fail validation stay as they are; a null text stays null.
    """
    one = F.broadcast(pads(df.sparkSession, secret))  # one row

    def replacement(v: Column) -> Column:
        kind, key = kind_of(v, disabled), (F.col("ipad"), F.col("opad"))
        token = F.coalesce(fake(kind, v, *key), sentinel(kind, v, *key)) if fakes else sentinel(kind, v, *key)
        return F.when(kind.isNull(), v).when(kind.isin(*QUASI), label(kind)).otherwise(token)

    with_parts = df.crossJoin(one)
    parts = let(
        F.transform(matches(F.col(text), disabled), replacement),
        lambda put: F.transform(segments(F.col(text), disabled), lambda s, i: F.concat(s, F.coalesce(F.get(put, i), F.lit("")))),
    )
    has = F.regexp_count(F.col(text), F.lit(pattern(disabled))) > 0
    masked = F.when(has, F.array_join(parts, "")).otherwise(F.col(text))
    return with_parts.withColumn(text, masked).drop("ipad", "opad")


def registry(df: DataFrame, secret: bytes, key: str, text: str = "text", disabled: list[str] | None = None) -> DataFrame:
    """(request_id, token, kind, value): the tokens that masking emits for each request."""
    one = F.broadcast(pads(df.sparkSession, secret))
    found = detect(df, key, text, disabled).filter(~F.col("kind").isin(*QUASI)).crossJoin(one)
    token = sentinel(F.col("kind"), F.col("value"), F.col("ipad"), F.col("opad"))
    return found.select(F.col(key).alias("request_id"), token.alias("token"), "kind", "value").distinct()


def generalise_ip(text: Column) -> Column:
    from maskloom.functions.text import PATTERNS

    return F.regexp_replace(text, PATTERNS["ip"], "[IP]")


def counts_by_kind(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def gauge(text: Column) -> Column:
    """Share of four quasi-identifier features present: an age, a record number, a date, an address of a machine."""
    features = [r"[0-9]{1,3} (years|ans|Jahre|años)", r"[0-9]{6,}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"]
    t = F.coalesce(text, F.lit(""))
    return sum((F.when(t.rlike(f), 1).otherwise(0) for f in features), F.lit(0)) / len(features)



def all_spans(df: DataFrame, key: str, spans: DataFrame | None = None, text: str = "text", disabled: list[str] | None = None) -> DataFrame:
    """(key, kind, value, start, end): findings of the detectors and ``spans`` (key, kind, start, end) of other producers, merged.

    Outside spans count if they lie inside their text and aren't empty; their value is cut from the
    text. Of overlapping spans the one that begins first stays, the longer of two that begin together,
    and of equal ones the outside one: a whole name wins over fragments inside it. Without rows in
    ``spans``, as when a producer failed, the findings alone remain.
    """
    own = detect(df, key, text, disabled).select(key, "kind", "start", "end", F.lit(1).alias("order"))
    every = own
    if spans is not None:
        at = df.select(F.col(key).alias("_key"), F.length(text).alias("n"))
        outside = spans.join(at, spans[key].eqNullSafe(at["_key"])).filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n")))
        every = own.unionByName(outside.select(key, "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(0).alias("order")))
    lists = every.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "order", "kind"))).alias("all"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    first = F.struct(F.lit(-1).cast("long").alias("reach"), none.alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        more = F.array_append(acc["kept"], F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind")))
        return F.when(x["start"] >= acc["reach"], F.struct((-x["back"]).alias("reach"), more.alias("kept"))).otherwise(acc)

    kept = lists.select(F.col(key).alias("_key"), F.aggregate("all", first, take)["kept"].alias("kept"))
    rows = kept.join(df.select(key, text), F.col("_key").eqNullSafe(F.col(key))).select(key, text, F.inline("kept"))
    value = F.substr(F.col(text), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return rows.select(key, "kind", value.alias("value"), "start", "end")


def mask_spans(df: DataFrame, found: DataFrame, secret: bytes, key: str, text: str = "text", places: bool = False, fakes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the spans ``found`` (key, kind, value, start, end; none overlapping) masked, the registry of emitted tokens).

    Quasi-identifiers become labels, and with ``places`` places as well. ``key`` is unique in ``df``; with
    ``fakes``, kinds with a realistic stand-in get it, which isn't registered.
    """
    one = F.broadcast(pads(df.sparkSession, secret))  # one row
    kinds = QUASI + PLACES if places else QUASI
    pad = (F.col("ipad"), F.col("opad"))
    stand_in = fake(F.col("kind"), F.col("value"), *pad) if fakes else F.lit(None).cast("string")
    put = found.crossJoin(one).withColumn("fake", stand_in).withColumn("token", F.when(~F.col("kind").isin(*kinds) & F.col("fake").isNull(), sentinel(F.col("kind"), F.col("value"), *pad)))
    put = put.withColumn("put", F.coalesce("token", "fake", label(F.col("kind"))))
    lists = put.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("puts"))
    n = F.size("puts")

    def gap(start: Column, stop: Column | None) -> Column:
        return F.substr(F.col(text), start.cast("int") + 1, F.length(text) if stop is None else (stop - start).cast("int"))

    pieces = F.transform("puts", lambda p, i: F.concat(gap(F.when(i > 0, F.get(F.col("puts"), i - 1)["end"]).otherwise(0), p["start"]), p["put"]))
    masked = F.concat(F.array_join(pieces, ""), gap(F.get(F.col("puts"), n - 1)["end"], None))
    joined = df.join(lists, df[key].eqNullSafe(lists["_key"]), "left")
    out = joined.withColumn(text, F.when(F.col("puts").isNull(), F.col(text)).otherwise(masked)).select(*df.columns)
    book = put.filter(F.col("token").isNotNull()).select(F.col(key).alias("request_id"), "token", "kind", "value").distinct()
    return out, book
