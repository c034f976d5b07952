"""Cross-site line dedup: lines that spread over many distinct sites stay once, in their first document.

A line is known by two hashes, a site by one. Each distinct (line, site) is kept once, with its
first document: that aggregation merges a common line's rows in every task before the shuffle and
deals the rest by site too, so no line meets in one task. Lines of one site fall away by minimum
and maximum; of the others, HyperLogLog sketches of sites merge by aggregation. An estimate clear of
the threshold decides; lines near it get an exact count of distinct sites. A spread line is removed
from every document but that of the smallest doc_id.

Cases: null text stays null, empty text stays empty; null sites count as no site; blank lines (white
space only, in any script) are never removed, others of any length can be; with ``min_words`` above
1, lines of fewer words (parted by white space) are left alone, too; repeated rows of the first document
all keep the line (a null doc_id comes after all others); a document whose every line goes keeps its
row with empty text. Other columns of ``docs``, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import broadcast_if_small, stash

# The code points with the property White_Space, as both engines' patterns write them.
_WHITE = r"\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE = ["h1", "h2"]


def _pattern(min_words: int) -> str:
    """Found in lines of at least ``min_words`` words (1 at least)."""
    return f"[^{_WHITE}]+" + f"[{_WHITE}]+[^{_WHITE}]+" * (max(1, min_words) - 1)


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _lines(docs: DataFrame, text_col: str, min_words: int, *more: Column) -> DataFrame:
    """(h1, h2, *more) of every distinct line of each row that can be removed."""
    rows = docs.select(*more, F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("line"))
    return rows.filter(F.col("line").rlike(_pattern(min_words))).select(*[c for c in rows.columns if c != "line"], *_key(F.col("line")))


def spread_lines(docs: DataFrame, min_sites: int = 5, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = 12) -> DataFrame:
    """Keys (h1, h2) of lines on at least ``min_sites`` distinct sites, with the id of their first document."""
    site = F.col(site_col).cast("string")
    lines = _lines(docs, text_col, min_words, F.col(id_col).alias("id"), F.when(site.isNotNull(), F.xxhash64(site)).alias("site"))
    placed = stash(lines.groupBy(*LINE, "site").agg(F.min("id").alias("id")), "lines")
    several = placed.groupBy(*LINE).agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min("id").alias("first_id"))
    several = stash(several.filter("a < b").select(*LINE, "first_id"), "several")
    seen = placed.filter(F.col("site").isNotNull()).join(broadcast_if_small(several.select(*LINE), 24), LINE, "left_semi")
    sketched = seen.groupBy(*LINE).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    sketched = stash(sketched.select(*LINE, F.hll_sketch_estimate("sketch").alias("about")), "sketched")
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    clear = sketched.filter(F.col("about") > min_sites + margin).select(*LINE)
    near = sketched.filter(F.col("about").between(min_sites - margin, min_sites + margin)).select(*LINE)
    exact = seen.join(broadcast_if_small(near, 24), LINE, "left_semi").groupBy(*LINE).count()  # a row for each site of a line
    exact = exact.filter(F.col("count") >= min_sites).select(*LINE)
    return several.join(clear.unionByName(exact), LINE, "left_semi")


def dedup_lines(docs: DataFrame, min_sites: int = 5, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed_col: str | None = None) -> DataFrame:
    """``docs`` with spread lines cut from ``text_col``; ``removed_col``, if named, counts the lines cut."""
    spread = stash(spread_lines(docs, min_sites, min_words, id_col, text_col, site_col), "spread")
    # what is cut from a text is gathered by id and text, so that a repeated or null id gathers no more than its text's lines
    text = F.col(text_col)
    of_row = [F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]
    hits = _lines(docs, text_col, min_words, *of_row).join(broadcast_if_small(spread, 32), LINE)
    hits = hits.filter(~F.col("id").eqNullSafe(F.col("first_id")))
    cut = hits.groupBy("id", "t1", "t2").agg(F.collect_set(F.struct(*LINE)).alias("cut"))
    whole = docs.select(F.struct("*").alias("row"), *of_row, text.alias("text")).alias("w")
    same = F.col("w.id").eqNullSafe(F.col("c.id")) & (F.col("w.t1") == F.col("c.t1")) & (F.col("w.t2") == F.col("c.t2"))
    joined = whole.join(cut.alias("c"), same, "left").select("row", "text", "cut")
    all_lines = F.split(F.col("text"), "\n")
    kept = F.filter(all_lines, lambda x: ~(F.array_contains("cut", F.struct(*_key(x))) & x.rlike(_pattern(min_words))))
    out = joined.select("row", "text", F.when(F.col("cut").isNull(), all_lines).otherwise(kept).alias("kept"))
    fields = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if removed_col:
        fields.append(F.coalesce(F.size(F.split(F.col("text"), "\n")) - F.size("kept"), F.lit(0)).cast("long").alias(removed_col))
    return out.select(*fields)


def oracle(min_sites: int = 5, min_words: int = 1) -> str:
    """The same in DuckDB over ``documents``: doc_id, text, n_removed."""
    return f"""
    WITH lines AS (
      SELECT d.doc_id, d.source, unnest(string_split(d.text, chr(10))) AS line,
             generate_subscripts(string_split(d.text, chr(10)), 1) AS pos FROM documents d),
    spread AS (
      SELECT line, min(doc_id) AS first_id FROM lines
      WHERE regexp_matches(line, '{_pattern(min_words)}')
      GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
    marked AS (
      SELECT l.doc_id, l.line, l.pos, s.line IS NOT NULL AND l.doc_id <> s.first_id AS gone
      FROM lines l LEFT JOIN spread s ON l.line = s.line)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
           count(*) FILTER (WHERE gone) AS n_removed
    FROM marked GROUP BY doc_id"""
