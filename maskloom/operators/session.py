"""Session state over ordered turns: aliases of earlier mentions, and gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskloom.functions.text import placed
from maskloom.operators import detect

LETTERS = r"[^\x00-@\[-`{-\x7f]+"
# Familiar forms of given names.
FAMILIAR = {"Mamadou": ["Momo", "Mamad"], "Mohamed": ["Momo", "Hamed"], "Ibrahima": ["Ibou"], "Fatoumata": ["Fatou"], "Abdoulaye": ["Ablaye", "Laye"], "Aminata": ["Ami"], "Ousmane": ["Ous"], "Alexander": ["Alex"], "Elizabeth": ["Liz", "Beth"], "William": ["Will", "Bill"]}
# Words that stand for anyone and are no alias of a name.
PRONOUNS = ["he", "she", "they", "it", "him", "her", "them", "his", "il", "elle", "lui", "eux", "er", "sie", "es", "ihm", "ihr", "él", "ella", "ellos"]


def words(text: Column) -> Column:
    """Runs of letters; split at everything that is no letter in ASCII or above."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-@\[-`{-\x7f]+"), lambda w: w != "")


def first_mentions(turns: DataFrame, session: str, order: str, text: str, gazetteer: DataFrame, keep: int = 200) -> DataFrame:
    """(session, name, first, nth, until) of gazetteer names (column ``name``): the turn of first mention, and
    the turn up to which it is remembered, when ``keep`` names that came later have pushed it out (null: to the end)."""
    said = turns.select(session, order, F.explode(F.array_distinct(words(F.col(text)))).alias("name"))
    known = said.join(gazetteer.select("name"), "name", "left_semi").groupBy(session, "name").agg(F.min(order).alias("first"))
    w = W.partitionBy(session).orderBy("first", "name")
    return known.withColumn("nth", F.row_number().over(w)).withColumn("until", F.lead("first", keep).over(w))


def aliases_of(names: DataFrame, familiar: dict[str, list[str]] = FAMILIAR) -> DataFrame:
    """(name, alias): the other spellings in lower, upper and title case, and the familiar forms of ``names`` (column ``name``)."""
    table = names.sparkSession.createDataFrame([(k, v) for k, vs in familiar.items() for v in vs] or [("", "")], "name string, alias string")
    cases = names.select("name", F.explode(F.array(F.lower("name"), F.upper("name"), F.initcap("name"))).alias("alias"))
    both = cases.unionByName(names.join(F.broadcast(table), "name").select("name", "alias"))  # a fixed table
    return both.filter((F.col("alias") != F.col("name")) & ~F.lower("alias").isin(*PRONOUNS)).distinct()


def alias_hits(turns: DataFrame, session: str, order: str, text: str, mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Turns in which an alias (aliases: name, alias) of a name is said that an earlier turn mentioned and that is still remembered."""
    said = turns.select(session, order, F.explode(F.array_distinct(words(F.col(text)))).alias("alias"))
    linked = mentions.join(aliases, "name").select(session, "name", "alias", "first", "until")
    live = (F.col(order) > F.col("first")) & (F.col("until").isNull() | (F.col(order) <= F.col("until")))
    return said.join(linked, [session, "alias"]).filter(live).select(session, order, "alias", "name")


def gazetteer_hits(df: DataFrame, key: list[str], text: str, gazetteer: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Counts of gazetteer words (column ``name``) per row, those of ``whitelist`` (column ``name``) left alone."""
    names = gazetteer.select("name").distinct()
    if whitelist is not None:
        names = names.join(whitelist.select("name"), "name", "left_anti")
    said = df.select(*key, F.explode(words(F.col(text))).alias("name"))
    return said.join(names, "name", "left_semi").groupBy(*key, "name").agg(F.count("*").alias("n"))


def word_spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name, start, end) of every run of letters."""
    rows = df.select(F.col(key).alias("_key"), F.inline(placed(F.col(text), LETTERS)))
    return rows.select(F.col("_key").alias(key), F.col("value").alias("name"), "start", (F.col("start") + F.length("value")).alias("end"))


def session_mask(turns: DataFrame, secret: bytes, key: str, session: str, order: str, gazetteer: DataFrame, text: str = "text",
                 whitelist: DataFrame | None = None, spans: DataFrame | None = None, keep: int = 200, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """Masked ``turns`` and their registry: detectors, gazetteer words (name, kind), aliases of names that earlier turns of the
    session mention, and ``spans`` of other producers together. ``key`` is unique to a turn; ``whitelist`` (name) stays clear.
    """
    known = gazetteer.select("name", "kind").dropDuplicates(["name"])
    if whitelist is not None:
        known = known.join(whitelist.select("name"), "name", "left_anti")
    said = word_spans(turns, key, text)
    direct = said.join(known, "name").select(key, "kind", "start", "end")
    names = known.filter(F.col("kind") == "nom_sn").select("name")
    mentions = first_mentions(turns, session, order, text, names, keep)
    hits = alias_hits(turns, session, order, text, mentions, aliases_of(names)).select(F.col(session).alias("_s"), F.col(order).alias("_o"), "alias").distinct()
    where = turns.select(F.col(key).alias("_k"), F.col(session).alias("_s"), F.col(order).alias("_o"))
    placed_hits = hits.join(where, ["_s", "_o"]).join(said, (F.col("_k") == F.col(key)) & (F.col("alias") == F.col("name"))).select(key, F.lit("nom_sn").alias("kind"), "start", "end")
    outside = direct.unionByName(placed_hits)
    if spans is not None:
        outside = outside.unionByName(spans.select(key, "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    found = detect.all_spans(turns, key, outside, text)
    return detect.mask_spans(turns, found, secret, key, text, places)
