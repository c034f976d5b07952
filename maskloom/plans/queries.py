"""Registered queries of the privacy operators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.operators import audit, calls, detect, fields, ingest, restore, session, spans, tenancy, vault
from maskloom.streaming import events as stream_events

SECRET = b"demonstration key, not a secret"
FORGED = T.OPEN + "a" * T.BODY + T.MIDDLE + "EM" + T.CLOSE
RE = T.pattern(plain=True)
NOW = 1_706_572_800  # a fixed instant inside the events


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text", "lang", "source")


# --- DuckDB building blocks -------------------------------------------------------------------

_IPAD = "".join(f"\\x{b ^ 0x36:02x}" for b in SECRET.ljust(64, b"\0"))
_OPAD = "".join(f"\\x{b ^ 0x5C:02x}" for b in SECRET.ljust(64, b"\0"))


def _luhn(v: str) -> str:
    digit = f"TRY_CAST({v}[j] AS INT)"
    return f"""(list_sum(list_transform(range(1, len({v}) + 1), lambda j: CASE WHEN (len({v}) - j) % 2 = 0 THEN {digit}
      WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"""


def _kind(v: str) -> str:
    return f"""CASE WHEN contains({v}, '@') THEN 'Email' WHEN starts_with({v}, '+') THEN 'PhoneSn' WHEN contains({v}, '.') THEN 'Ip' WHEN contains({v}, '-') THEN 'Date'
      WHEN NOT {_luhn(v)} THEN NULL WHEN len({v}) = 13 AND starts_with({v}, '1') THEN 'CniSn' ELSE 'CreditCard' END"""


def _hexed(msg: str) -> str:
    return f"sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode({msg}))))"


def _base32(h: str) -> str:
    n = "(strpos('0123456789abcdef', {h}[{i}]) - 1)"
    hi, lo = n.format(h=h, i="(i * 5) // 4 + 1"), n.format(h=h, i="(i * 5) // 4 + 2")
    return f"list_aggregate(list_transform(range(0, 26), lambda i: '{T.BASE32}'[(({hi} * 16 + {lo}) // [8, 4, 2, 1][(i * 5) % 4 + 1]) % 32 + 1]), 'string_agg', '')"


_FOUND = f"""
found AS (
  SELECT doc_id, lang, source, s, m, i, m[i] AS value, {_kind('m[i]')} AS kind FROM (
    SELECT doc_id, lang, source, regexp_extract_all(text, '{RE}') AS m, regexp_split_to_array(text, '{RE}') AS s,
           unnest(range(1, len(regexp_extract_all(text, '{RE}')) + 1)) AS i FROM documents)),
hashed AS (SELECT *, {_hexed("kind || chr(31) || value")} AS h FROM found),
put AS (
  SELECT *, CASE WHEN kind IS NULL THEN value WHEN kind IN ('Ip', 'Date', 'CreditCard') THEN '[' || upper(kind) || ']'
    ELSE '{T.OPEN}' || {_base32('h')} || '{T.MIDDLE}' || CASE kind WHEN 'Email' THEN 'EM' WHEN 'PhoneSn' THEN 'PH' WHEN 'CniSn' THEN 'CN' ELSE 'XX' END || '{T.CLOSE}' END AS repl
  FROM hashed),
masked AS (
  SELECT d.doc_id, coalesce(p.t, d.text) AS text FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(s[i] || repl, '' ORDER BY i) || any_value(s[len(s)]) AS t FROM put GROUP BY doc_id) p USING (doc_id))"""
_LABELLED = f"""
back AS (
  SELECT d.doc_id, coalesce(p.t, d.text) AS text, coalesce(p.n, 0) AS n FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(s[i] || CASE WHEN kind IN ('Ip', 'Date', 'CreditCard') THEN repl ELSE value END, '' ORDER BY i) || any_value(s[len(s)]) AS t,
           count(*) FILTER (WHERE kind IN ('Email', 'PhoneSn', 'CniSn')) AS n FROM put GROUP BY doc_id) p USING (doc_id))"""

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- detection and masking --------------------------------------------------------------------


@query(f"WITH {_FOUND} SELECT kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY kind")
def pii_counts_by_kind(spark, sf):
    return detect.counts_by_kind(detect.detect(_docs(spark, sf), "doc_id"))


@query(f"WITH {_FOUND} SELECT lang, source, kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL")
def pii_counts_by_lang_source(spark, sf):
    docs = _docs(spark, sf)
    found = detect.detect(docs.withColumn("key", F.struct("lang", "source")), "key")
    return detect.counts_by_kind(found.select("key.lang", "key.source", "kind"), "lang", "source")


@query(f"SELECT doc_id, v AS value, {_luhn('v')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS v FROM documents)")
def luhn_cards(spark, sf):
    found = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.PATTERNS["digits"]), F.lit(0))).alias("value"))
    return found.withColumn("valid", F.call_function("luhn_check", F.col("value")))


@query(f"SELECT doc_id, regexp_replace(text, '{T.PATTERNS['ip']}', '[IP]', 'g') AS text FROM documents")
def generalise_ip(spark, sf):
    return _docs(spark, sf).select("doc_id", detect.generalise_ip(F.col("text")).alias("text"))


@query(f"WITH {_FOUND} SELECT doc_id, text FROM masked")
def tokenise_documents(spark, sf):
    return detect.mask(_docs(spark, sf), SECRET).select("doc_id", "text")


@query(f"WITH {_FOUND} SELECT DISTINCT doc_id AS request_id, repl AS token, kind, value FROM put WHERE kind IN ('Email', 'PhoneSn', 'CniSn')")
def emission_registry(spark, sf):
    return detect.registry(_docs(spark, sf), SECRET, "doc_id")


@query(f"WITH {_FOUND}, {_LABELLED} SELECT doc_id, text, n AS restored, 0 AS unresolved FROM back")
def restore_roundtrip(spark, sf):
    docs = _docs(spark, sf)
    masked, book = detect.mask(docs, SECRET), detect.registry(docs, SECRET, "doc_id")
    return restore.restore(masked, book, "doc_id")


@query(f"WITH {_FOUND}, {_LABELLED} SELECT doc_id, '[REDACTED]' AS text, n AS restored, 1 AS unresolved FROM back")
def restore_forged(spark, sf):
    docs = _docs(spark, sf)
    masked, book = detect.mask(docs, SECRET), detect.registry(docs, SECRET, "doc_id")
    return restore.restore(masked.withColumn("text", F.concat("text", F.lit(FORGED))), book, "doc_id")


@query(f"WITH {_FOUND}, {_LABELLED} SELECT doc_id, text FROM back")
def restore_bare_bodies(spark, sf):
    docs = _docs(spark, sf)
    masked, book = detect.mask(docs, SECRET), detect.registry(docs, SECRET, "doc_id")
    bare = masked.withColumn("text", F.regexp_replace("text", f"{T.OPEN}([a-z2-7]{{26}}){T.MIDDLE}[A-Z]+{T.CLOSE}", " $1 "))
    wrapped = restore.wrap_bare(bare, book, "doc_id").withColumn("text", F.regexp_replace("text", f" ({T.SENTINEL}) ", "$1"))
    return restore.restore(wrapped, book, "doc_id").select("doc_id", "text")


@query(f"""WITH {_FOUND} SELECT doc_id, 1 + len(regexp_extract_all(text, '{T.OPEN}[a-z2-7]{{26}}{T.MIDDLE}[A-Z]+{T.CLOSE}')) AS incomplete_restorations, CAST(1 AS BIGINT) AS blocked_outputs FROM masked""")
def sentinel_scan_counts(spark, sf):
    masked = detect.mask(_docs(spark, sf), SECRET).withColumn("text", F.concat("text", F.lit(FORGED + T.OPEN + "cut" + T.CLOSE)))
    return restore.sentinel_counts(masked, "doc_id")


_LEN = "list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0)"


@query(f"""WITH {_FOUND} SELECT doc_id, kind, value, start, start + len(value) AS "end", strlen(d.text[1:start]) AS byte_start
FROM (SELECT doc_id, kind, value, CAST({_LEN} AS BIGINT) AS start FROM found WHERE kind IS NOT NULL) JOIN documents d USING (doc_id)""")
def spans_with_offsets(spark, sf):
    return detect.detect(_docs(spark, sf), "doc_id")


@query("""WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, (CAST(regexp_matches(t, '[0-9]{1,3} (years|ans|Jahre|años)') AS INT) + CAST(regexp_matches(t, '[0-9]{6,}') AS INT)
 + CAST(regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS INT) + CAST(regexp_matches(t, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') AS INT)) / 4.0::DOUBLE AS score,
 score > 0.25 AS flagged FROM f""")
def quasi_id_gauge(spark, sf):
    score = detect.gauge(F.col("text"))
    return _docs(spark, sf).select("doc_id", score.alias("score"), (score > 0.25).alias("flagged"))


@query(f"""SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, {_kind('v')} AS kind FROM (
SELECT page_id, unnest(regexp_extract_all(html, '{RE}')) AS v FROM pages)) WHERE kind IS NOT NULL GROUP BY ALL""")
def html_pii(spark, sf):
    return detect.counts_by_kind(detect.detect(_t(spark, sf, "pages"), "page_id", "html"), "page_id")


# --- spans ------------------------------------------------------------------------------------


@query("""SELECT doc_id, unnest(range(0, greatest(n_chars - 64 - 1, 0) + 1, 447)) AS start, least(start + 511, n_chars) AS "end" FROM documents WHERE n_chars > 0""")
def overlap_windows(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.explode(spans.windows(F.col("n_chars"))).alias("w"))
    return docs.select("doc_id", "w.start", "w.end")


_WORDS = """w AS (SELECT conv_id, turn, k, len(ws[k]) AS n, CAST(list_sum(list_transform(ws[1:k-1], lambda x: len(x) + 1)) AS BIGINT) AS before, ws[k] AS word
  FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM conversations))"""


def _placed_words(spark, sf):
    """Words between spaces with the letters before them."""
    pairs = T.let(F.split("text", " "), lambda ws: F.arrays_zip(ws.alias("word"), T.running(F.transform(ws, lambda x: F.length(x))).alias("start")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(pairs).alias("pos", "w")).select("conv_id", "turn", "pos", "w.word", "w.start")


def _tokens(spark, sf):
    """Words of conversations with made-up labels: those of over 8 letters are persons, of over 6 places."""
    w = _placed_words(spark, sf).withColumn("start", F.col("start") + F.col("pos"))
    start, n = F.col("start"), F.length("word")
    label = F.when(n > 8, "B-PER").when(n > 6, "I-LOC").otherwise("O")
    return w.select(F.struct("conv_id", "turn").alias("key"), "pos", (start - F.col("pos")).alias("start"), (start - F.col("pos") + n).alias("end"), label.alias("label"), F.least(F.lit(1.0), 0.5 + n / 32).alias("prob"))


@query(f"""WITH {_WORDS},
t AS (SELECT conv_id, turn, k, coalesce(before, 0) - (k - 1) AS s, coalesce(before, 0) - (k - 1) + n AS e,
  CASE WHEN n > 8 THEN 'Person' WHEN n > 6 THEN 'Location' END AS kind, least(1.0::DOUBLE, 0.5::DOUBLE + n / 32.0::DOUBLE) AS prob FROM w),
j AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER o AND s IS NOT DISTINCT FROM lag(e) OVER o THEN 0 ELSE 1 END AS new FROM t WINDOW o AS (PARTITION BY conv_id, turn ORDER BY k)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY k) AS island FROM j)
SELECT conv_id, turn, kind, min(s) AS start, max(e) AS "end", round(avg(prob), 9) AS score FROM g WHERE kind IS NOT NULL GROUP BY conv_id, turn, island, kind HAVING avg(prob) >= 0.70""")
def bio_islands(spark, sf):
    out = spans.bio_islands(_tokens(spark, sf), "key")
    return out.select("key.conv_id", "key.turn", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 9).alias("score"))


_NGRAMS = f"""{_WORDS},
s AS (SELECT conv_id, turn, CASE WHEN n > 6 THEN 'long' ELSE 'short' END AS kind, coalesce(before, 0) AS start, coalesce(before, 0) + n * (1 + k % 3) AS "end" FROM w WHERE n > 0)"""


@query(f"""WITH {_NGRAMS} SELECT conv_id, turn, kind, start, "end" FROM (SELECT *, max("end") OVER (PARTITION BY conv_id, turn, kind ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s)
WHERE r IS NULL OR "end" > r""")
def span_dedup_contained(spark, sf):
    w = _placed_words(spark, sf).filter(F.length("word") > 0)
    start, n = (F.col("start") + F.col("pos")).cast("long"), F.length("word")
    made = w.select(F.struct("conv_id", "turn").alias("key"), F.when(n > 6, "long").otherwise("short").alias("kind"), start.alias("start"), (start + n * (1 + (F.col("pos") + 1) % 3)).alias("end"))
    return spans.drop_contained(made, "key").select("key.conv_id", "key.turn", "kind", "start", "end")


# --- nested documents and sessions --------------------------------------------------------------


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS msg_idx, 'content' AS channel, text FROM conversations""")
def chat_field_traversal(spark, sf):
    turns = _t(spark, sf, "conversations")
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    parsed = fields.parse(turns.groupBy("conv_id").agg(body.alias("body")))
    return fields.chat_fields(parsed, "conv_id").select("conv_id", "msg_idx", "channel", "text")


_SPLIT = r"regexp_split_to_array(coalesce(text, ''), '[\x00-@\[-`{-\x7f]+')"


def _names(spark, sf):
    """Capitalised words that begin documents of the conversations' first turns, as a stand-in gazetteer."""
    first = _t(spark, sf, "conversations").filter("turn = 0").select(F.explode(session.words(F.col("text"))).alias("name"))
    return first.filter(F.col("name").rlike("^[A-Z][a-z]{5,}$")).distinct()


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({_SPLIT}) AS name FROM conversations),
g AS (SELECT DISTINCT name FROM w WHERE turn = 0 AND regexp_matches(name, '^[A-Z][a-z]{{5,}}$'))
SELECT conv_id, turn, name, count(*) AS n FROM w WHERE name IN (SELECT name FROM g) AND name NOT IN (SELECT upper(n_name[1]) || lower(n_name[2:]) FROM nation) GROUP BY ALL""")
def gazetteer_mask(spark, sf):
    countries = _t(spark, sf, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))).alias("name"))
    return session.gazetteer_hits(_t(spark, sf, "conversations"), ["conv_id", "turn"], "text", _names(spark, sf), countries)


@query("""WITH w AS (SELECT unnest(string_split(upper(n_name), ' ')) AS name FROM nation)
SELECT name FROM w WHERE name NOT IN (SELECT upper(n_name) FROM nation WHERE n_regionkey IN (0, 1))""")
def geo_whitelist(spark, sf):
    nation = _t(spark, sf, "nation")
    words = nation.select(F.explode(F.split(F.upper("n_name"), " ")).alias("name"))
    return words.join(nation.filter(F.col("n_regionkey").isin(0, 1)).select(F.upper("n_name").alias("name")), "name", "left_anti")


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest({_SPLIT}) AS name FROM conversations),
g AS (SELECT DISTINCT name FROM w WHERE turn = 0 AND regexp_matches(name, '^[A-Z][a-z]{{5,}}$')),
f AS (SELECT conv_id, name, min(turn) AS first FROM w WHERE name IN (SELECT name FROM g) GROUP BY ALL)
SELECT w.conv_id, w.turn, w.name AS alias, f.name AS name FROM w JOIN f ON w.conv_id = f.conv_id AND w.name = lower(f.name) AND w.turn > f.first""")
def session_alias(spark, sf):
    turns, names = _t(spark, sf, "conversations"), _names(spark, sf)
    known = session.first_mentions(turns, "conv_id", "turn", "text", names, keep=1_000_000)
    return session.alias_hits(turns, "conv_id", "turn", "text", known, names.withColumn("alias", F.lower("name")))


# --- masking with more than the detectors, documents out and back --------------------------------

_NAME = "[A-Z][a-z]{7,}"


def _rewritten(src: str, regex: str, kind: str, put: str, keys: str = "conv_id, turn") -> str:
    """(keys, text): ``src`` (keys, text) with every match ``v`` of ``regex`` replaced by the expression ``put``."""
    return f"""rewritten AS (SELECT d.*, coalesce(p.t, d.text) AS new_text FROM ({src}) d LEFT JOIN (
      SELECT {keys}, string_agg(s[i] || {put}, '' ORDER BY i) || any_value(s[len(s)]) AS t FROM (
        SELECT *, {_hexed("kind || chr(31) || v")} AS h FROM (
          SELECT *, {kind} AS kind FROM (SELECT {keys}, s, i, m[i] AS v FROM (
            SELECT {keys}, regexp_split_to_array(text, '{regex}') AS s, regexp_extract_all(text, '{regex}') AS m,
                   unnest(range(1, len(regexp_extract_all(text, '{regex}')) + 1)) AS i FROM ({src})))))
      GROUP BY {keys}) p USING ({keys}))"""


_TOKEN = f"""CASE WHEN kind IS NULL THEN v WHEN kind IN ('Ip', 'Date', 'CreditCard') THEN '[' || upper(kind) || ']' ELSE '{T.OPEN}' || {_base32('h')} || '{T.MIDDLE}'
  || CASE kind WHEN 'Email' THEN 'EM' WHEN 'PhoneSn' THEN 'PH' WHEN 'CniSn' THEN 'CN' WHEN 'Person' THEN 'PE' WHEN 'nom_sn' THEN 'NM' ELSE 'XX' END || '{T.CLOSE}' END"""
_LABEL_ONLY = "CASE WHEN kind IN ('Ip', 'Date', 'CreditCard') THEN '[' || upper(kind) || ']' ELSE v END"
_TURNS = "SELECT conv_id, turn, role, text FROM conversations"


@query("WITH " + _rewritten(_TURNS, f"{RE}|{_NAME}", f"CASE WHEN regexp_full_match(v, '{_NAME}') THEN 'Person' ELSE {_kind('v')} END", _TOKEN) + " SELECT conv_id, turn, new_text AS text FROM rewritten")
def mask_with_spans(spark, sf):
    """Turns masked by the detectors and by spans of another producer, here long capitalised words as persons."""
    turns = _t(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = turns.select(F.col("key").alias("k"), F.inline(T.placed(F.col("text"), _NAME)))
    outside = found.select(F.col("k").alias("key"), F.lit("Person").alias("kind"), "start", (F.col("start") + F.length("value")).alias("end"))
    masked, _ = detect.mask_spans(turns, detect.all_spans(turns, "key", outside), SECRET, "key")
    return masked.select("conv_id", "turn", "text")


_LETTERS = r"[^\x00-@\[-`{-\x7f]+"
_SESSION = f"""w AS (SELECT DISTINCT conv_id, turn, unnest({_SPLIT}) AS name FROM conversations),
c AS (SELECT upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation),
g AS (SELECT DISTINCT name FROM w WHERE turn = 0 AND regexp_matches(name, '^[A-Z][a-z]{{5,}}$') AND name NOT IN (SELECT name FROM c)),
f AS (SELECT *, lead(first, 200) OVER (PARTITION BY conv_id ORDER BY first, name) AS until FROM (SELECT conv_id, name, min(turn) AS first FROM w WHERE name IN (SELECT name FROM g) GROUP BY ALL)),
a AS (SELECT DISTINCT w.conv_id, w.turn, w.name FROM w JOIN f ON w.conv_id = f.conv_id AND w.name IN (lower(f.name), upper(f.name)) AND w.turn > f.first AND (f.until IS NULL OR w.turn <= f.until)),
hit AS (SELECT * FROM a UNION SELECT conv_id, turn, name FROM w WHERE name IN (SELECT name FROM g)),
hits AS (SELECT conv_id || '/' || turn || '/' || name AS k FROM hit), """
_SESSION_KIND = f"CASE WHEN conv_id || '/' || turn || '/' || v IN (SELECT k FROM hits) THEN 'nom_sn' WHEN regexp_full_match(v, '{_LETTERS}') THEN NULL ELSE {_kind('v')} END"


@query(f"WITH {_SESSION}{_rewritten(_TURNS, RE + '|' + _LETTERS, _SESSION_KIND, _TOKEN)} SELECT conv_id, turn, new_text AS text FROM rewritten")
def session_mask(spark, sf):
    """Turns masked by detectors, a gazetteer without country names, and other forms of names that earlier turns mention."""
    turns = _t(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    countries = _t(spark, sf, "nation").select(F.initcap(F.lower("n_name")).alias("name"))
    names = _names(spark, sf).withColumn("kind", F.lit("nom_sn"))
    masked, _ = session.session_mask(turns, SECRET, "key", "conv_id", "turn", names, whitelist=countries)
    return masked.select("conv_id", "turn", "text")


def _bodies(spark, sf):
    """Chat requests: users' turns as parts beside an image, assistants' as reasoning, or else as a tool call's arguments."""
    text = F.col("text")
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("u").alias("image_url")))
    call = F.array(F.struct(F.lit("1").alias("id"), F.struct(F.lit("f").alias("name"), text.alias("arguments")).alias("function")))
    user = F.to_json(F.struct("role", parts.alias("content")))
    other = F.to_json(F.struct("role", F.when(F.col("role") == "assistant", text).alias("reasoning_content"), F.when(F.col("role") == "system", call).alias("tool_calls"), F.lit(1).alias("unknown")))
    message = F.when(F.col("role") == "user", user).otherwise(other)
    turns = _t(spark, sf, "conversations").withColumn("message", message)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "message"))), lambda m: m["message"]), ",")
    return turns.groupBy("conv_id").agg(F.concat(F.lit('{"model":"m","more":{"x":[1,null]},"messages":['), listed, F.lit("]}")).alias("body"))


_NUMBERED = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, role, text FROM conversations"
_CHANNEL = "CASE role WHEN 'user' THEN 'part' WHEN 'assistant' THEN 'reasoning' ELSE 'tool_args' END"


@query("WITH " + _rewritten(_NUMBERED, RE, _kind("v"), _TOKEN) + f" SELECT conv_id, turn AS msg_idx, {_CHANNEL} AS channel, new_text AS text, 'm' AS model, '[1,null]' AS more FROM rewritten")
def request_masking(spark, sf):
    """Leaves of requests after their masking in place; what isn't text stays in the body."""
    masked, _ = fields.mask_requests(_bodies(spark, sf), "conv_id", SECRET)
    parsed = fields.parse(masked.select("conv_id", "body"))
    whole = masked.select("conv_id", F.get_json_object("body", "$.more.x").alias("more"), F.get_json_object("body", "$.model").alias("model"))
    return fields.chat_fields(parsed, "conv_id").select("conv_id", "msg_idx", "channel", "text").join(whole, "conv_id")


@query("WITH " + _rewritten(_NUMBERED, RE, _kind("v"), _LABEL_ONLY) + f", n AS (SELECT conv_id, sum(len(list_filter(regexp_extract_all(text, '{RE}'), lambda v: {_kind('v')} IN ('Email', 'PhoneSn', 'CniSn')))) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(turn AS INT) AS choice, {_CHANNEL} AS channel, new_text AS text, CAST(n AS BIGINT) AS restored, CAST(0 AS BIGINT) AS unresolved FROM rewritten JOIN n USING (conv_id)")
def request_roundtrip(spark, sf):
    """Requests are masked, echoed as responses of one choice a message, and restored from the registry in place."""
    masked, book = fields.mask_requests(_bodies(spark, sf), "conv_id", SECRET)
    choices = F.transform(F.try_variant_get(F.try_parse_json("body"), "$.messages", "array<variant>"), lambda m: F.concat(F.lit('{"index":0,"message":'), F.to_json(m), F.lit("}")))
    echo = masked.select("conv_id", F.concat(F.lit('{"id":"r","choices":['), F.array_join(choices, ","), F.lit("]}")).alias("body"))
    done = restore.restore_responses(echo, book, "conv_id")
    leaves = fields.response_fields(done.select("conv_id", "body"), "conv_id").select("conv_id", "choice", "channel", "text")
    return leaves.join(done.select("conv_id", "restored", "unresolved"), "conv_id")


@query(f"WITH {_FOUND}, {_LABELLED} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 3 THEN '[REDACTED]' ELSE text END AS text, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE n END AS restored, CAST(CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS unresolved FROM back")
def legacy_restore(spark, sf):
    """Legacy responses: some end in a forged sentinel, some have another shape and pass as they are."""
    docs = _docs(spark, sf)
    masked, book = detect.mask(docs, SECRET), detect.registry(docs, SECRET, "doc_id")
    text = F.when(F.col("doc_id") % 5 == 3, F.concat("text", F.lit(FORGED))).otherwise(F.col("text"))
    body = F.when(F.col("doc_id") % 5 == 4, F.lit('{"data":["untouched"]}')).otherwise(F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices"))))
    done = restore.restore_responses(masked.select("doc_id", body.alias("body")), book, "doc_id")
    return done.select("doc_id", F.get_json_object("body", "$.choices[0].text").alias("text"), "restored", "unresolved")


@query("""WITH b AS (SELECT event_id, props, event_id % 3 AS k FROM events)
SELECT event_id, CASE WHEN k = 1 OR event_id % 7 = 0 THEN 'BadRequest' END AS error, CASE WHEN k = 1 OR event_id % 7 = 0 THEN NULL WHEN k = 0 THEN [props] ELSE [props, 'two'] END AS texts FROM b""")
def legacy_requests(spark, sf):
    """Legacy prompts, single or several; streams and bodies without JSON are refused."""
    one, two = F.to_json(F.struct(F.col("props").alias("prompt"))), F.to_json(F.struct(F.array("props", F.lit("two")).alias("prompt")))
    stream = F.to_json(F.struct(F.col("props").alias("prompt"), F.lit(True).alias("stream")))
    k = F.col("event_id") % 3
    body = F.when(F.col("event_id") % 7 == 0, "no json").when(k == 0, one).when(k == 1, stream).otherwise(two)
    parsed = fields.legacy_requests(_events(spark, sf).select("event_id", body.alias("body")))
    texts = fields.prompt_fields(parsed, "event_id").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("texts"))
    return parsed.select("event_id", "error").join(texts, "event_id", "left")


# --- audit --------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT conv_id, {_kind('v')} AS kind FROM (SELECT conv_id, unnest(regexp_extract_all(text, '{RE}')) AS v FROM conversations)),
b AS (SELECT conv_id, kind, count(*) AS n FROM f WHERE kind IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, '{{' || coalesce(string_agg('"' || kind || '":' || n, ',' ORDER BY kind) FILTER (WHERE kind NOT IN ('Ip', 'Date', 'CreditCard')), '') || '}}' AS j,
 sum(n) FILTER (WHERE kind IN ('Ip', 'Date', 'CreditCard')) AS q FROM b GROUP BY conv_id)
SELECT c.conv_id, coalesce(j, '{{}}') AS masked_by_type, CAST(coalesce(q, 0) AS BIGINT) AS quasi_id_flags FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id)""")
def conversation_receipts(spark, sf):
    turns = _t(spark, sf, "conversations")
    return audit.receipts(turns, detect.detect(turns, "conv_id"), "conv_id")


@query(f"""WITH {_FOUND}, c AS (SELECT source, kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL)
SELECT source, kind, CASE WHEN n >= 5 THEN n ELSE 0 END AS n, min(n >= 5) OVER (PARTITION BY source) AS publishable FROM c""")
def k_anonymous_report(spark, sf):
    found = detect.detect(_docs(spark, sf), "source")
    return audit.k_anonymous(detect.counts_by_kind(found, "source"), 5, "source")


def _events(spark, sf):
    return _t(spark, sf, "events")


_SECONDS = "floor(epoch(ts))::BIGINT"


@query(f"""WITH e AS (SELECT event_type, {_SECONDS} AS s FROM events),
p(period, lo, hi) AS (VALUES {", ".join(f"('{p}', {NOW - w}, {NOW + 1})" for p, w in audit.PERIODS.items())}, ('all', -9000000000, 9000000000)),
j AS (SELECT p.period, e.* FROM p JOIN e ON s >= lo AND s < hi), c AS (SELECT period, event_type, count(*) AS n FROM j GROUP BY ALL),
r AS (SELECT period, string_agg(event_type || ':' || CASE WHEN n >= 100 THEN n ELSE 0 END, ',' ORDER BY event_type) AS cells, bool_and(n >= 100) AS publishable FROM c GROUP BY period),
w AS (SELECT period, count(*) AS n, min(s) AS a, max(s) AS b FROM j GROUP BY period)
SELECT p.period, CAST(CASE WHEN p.period = 'all' THEN coalesce(a, 0) ELSE lo END AS BIGINT) AS period_start, CAST(CASE WHEN p.period = 'all' THEN coalesce(b, {NOW}) + 1 ELSE hi END AS BIGINT) AS period_end,
CAST(coalesce(w.n, 0) AS BIGINT) AS total_requests, coalesce(cells, '') AS cells, coalesce(publishable, false) AS publishable FROM p LEFT JOIN w USING (period) LEFT JOIN r USING (period)""")
def rolling_period_report(spark, sf):
    """Reports of every period over receipts, one receipt an event."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf).select(at.alias("ts_unix"), F.struct(F.create_map(F.col("event_type"), F.lit(1).cast("long")).alias("masked_by_type")).alias("counters"))
    out = None
    for period in [*audit.PERIODS, "all"]:
        one = audit.period_report(rows, period, NOW, 100)
        out = one if out is None else out.unionByName(one)
    cells = F.array_join(F.transform(F.array_sort(F.map_entries("redacted")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.withColumn("cells", cells).drop("redacted")


_POLICY = {"k": 5, "disabled": []}


@query(f"""WITH f AS (SELECT conv_id, {_kind('v')} AS kind FROM (SELECT conv_id, unnest(regexp_extract_all(text, '{RE}')) AS v FROM conversations)),
b AS (SELECT conv_id, kind, count(*) AS n FROM f WHERE kind IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, '{{' || coalesce(string_agg('"' || kind || '":' || n, ',' ORDER BY kind) FILTER (WHERE kind NOT IN ('Ip', 'Date', 'CreditCard')), '') || '}}' AS j,
 sum(n) FILTER (WHERE kind IN ('Ip', 'Date', 'CreditCard')) AS q FROM b GROUP BY conv_id),
x AS (SELECT c.conv_id, '{{"tenant_id":"t' || conv_id % 3 || '","session_ref_hashed":"' || sha256('session:t' || conv_id % 3 || chr(31) || 'key' || conv_id) || '","ts_unix":' || ({NOW} + conv_id) || ',"engine_version":"1","policy_hash":"{audit.policy_hash(_POLICY)}","counters":{{"masked_by_type":'
 || coalesce(j, '{{}}') || ',"quasi_id_flags":' || coalesce(q, 0)::BIGINT || ',"incomplete_restorations":' || turns || ',"blocked_outputs":0}}}}' AS receipt
 FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c LEFT JOIN r USING (conv_id))
SELECT conv_id, receipt, {_hexed('receipt')} AS sig_agent, true AS valid FROM x""")
def sealed_receipts(spark, sf):
    """Whole receipts of conversations whose answers each keep one forged sentinel, sealed and checked."""
    turns = _t(spark, sf, "conversations")
    tenant = F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string"))
    ref = tenancy.session_ref(tenant, F.concat(F.lit("key"), F.col("conv_id").cast("string")))
    requests = turns.select("conv_id").distinct().select("conv_id", tenant.alias("tenant_id"), ref.alias("session_ref_hashed"), (F.lit(NOW) + F.col("conv_id")).alias("ts_unix"))
    answers = restore.sentinel_counts(turns.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(FORGED))), "conv_id")
    rows = audit.sealed(audit.full_receipts(requests, detect.detect(turns, "conv_id"), answers, "conv_id", _POLICY), SECRET)
    return audit.verified(rows, SECRET).select("conv_id", audit.canonical().alias("receipt"), "sig_agent", "valid")


_RUNS = """r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
 SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)),
g AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n, min(floor(epoch(ts))::BIGINT) AS period_start, max(floor(epoch(ts))::BIGINT) + 1 AS period_end, bool_and(value < 150) AS ok FROM r GROUP BY user_id, run)"""


def _grouped_runs(spark, sf):
    runs = audit.runs(_events(spark, sf), "event_type", ["ts", "event_id"], ["user_id"])
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min(at).alias("period_start"), (F.max(at) + 1).alias("period_end"), F.bool_and(F.col("value") < 150).alias("ok"))


@query(f"WITH {_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, event_type, n, period_start, period_end FROM g")
def ingest_runs(spark, sf):
    return _grouped_runs(spark, sf).drop("ok")


@query(f"""WITH {_RUNS} SELECT user_id, count(*) AS n_groups, count(*) FILTER (WHERE sent) AS n_sent, CAST(coalesce(sum(n) FILTER (WHERE sent), 0) AS BIGINT) AS cursor
FROM (SELECT *, bool_and(ok) OVER (PARTITION BY user_id ORDER BY run) AS sent FROM g) GROUP BY user_id""")
def ingest_prefix(spark, sf):
    sent = audit.flushed_prefix(_grouped_runs(spark, sf), ["user_id"])
    return sent.groupBy("user_id").agg(F.count("*").alias("n_groups"), F.count_if("sent").alias("n_sent"), F.coalesce(F.sum(F.when(F.col("sent"), F.col("n"))), F.lit(0)).alias("cursor"))


# --- tenancy and call policy ----------------------------------------------------------------------


@query("""WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s, last_value(CASE WHEN event_type = 'click' THEN floor(epoch(ts))::BIGINT END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_at FROM events)
SELECT event_id, user_id, s - seen_at AS age, coalesce(s - seen_at <= 300, false) AS fresh FROM e""")
def cached_verify_asof(spark, sf):
    events = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return tenancy.cached(events, "user_id", "ts", F.col("event_type") == "click", 300, ["event_id"]).select("event_id", "user_id", "age", "fresh")


@query("""SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type""")
def version_purge(spark, sf):
    return tenancy.purges(_events(spark, sf), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "before")


@query("""SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_seen FROM events GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 64""")
def seen_tenants_fifo(spark, sf):
    return tenancy.seen_tenants(_events(spark, sf), "user_id", "ts").select("user_id", F.unix_seconds(F.col("first_seen").cast("timestamp")).alias("first_seen"))


@query(f"""WITH e AS (SELECT *, {_SECONDS} AS s FROM events),
d AS (SELECT user_id % 10 AS tenant, sha256(CAST(user_id AS VARCHAR)) AS digest, value < 150 AS valid, s AS t0 FROM e WHERE event_id % 3 = 0),
p AS (SELECT user_id % 10 AS tenant, CASE WHEN user_id % 2 = 0 AND s >= {NOW} - 200000 THEN 2 ELSE 1 END AS version, s AS t0 FROM e WHERE event_id % 3 = 1 AND s <= {NOW}),
c AS (SELECT tenant, max(t0) AS purged FROM (SELECT *, lag(version) OVER (PARTITION BY tenant ORDER BY t0, version) AS b FROM p) WHERE b <> version GROUP BY tenant),
k AS (SELECT tenant, digest, arg_max(valid, t0) AS valid FROM d LEFT JOIN c USING (tenant) WHERE t0 <= {NOW} AND {NOW} - t0 <= 600000 AND (purged IS NULL OR t0 >= purged) GROUP BY tenant, digest),
q AS (SELECT event_id, (user_id + event_id % 2) % 10 AS tenant, sha256(CAST(user_id AS VARCHAR)) AS digest FROM e WHERE event_id % 3 = 2)
SELECT event_id, tenant, coalesce(valid, false) AS accepted FROM q LEFT JOIN k USING (tenant, digest)""")
def tenant_isolation(spark, sf):
    """Cached decisions after expiry and purges; half the requests name another tenant than the token's."""
    e = _events(spark, sf).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("digest", F.sha2(F.col("user_id").cast("string"), 256)).withColumn("tenant", F.col("user_id") % 10)
    made = e.filter("event_id % 3 = 0").select("tenant", "digest", (F.col("value") < 150).alias("valid"), "at")
    version = F.when((F.col("user_id") % 2 == 0) & (F.col("at") >= NOW - 200_000), 2).otherwise(1)
    polls = e.filter("event_id % 3 = 1").select("tenant", version.alias("version"), "at")
    asked = e.filter("event_id % 3 = 2").select("event_id", ((F.col("user_id") + F.col("event_id") % 2) % 10).alias("tenant"), "digest")
    return tenancy.accepted(asked, tenancy.live_decisions(made, polls, 600_000, NOW)).select("event_id", "tenant", "accepted")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'UpstreamTimeout' ELSE 'Upstream' END AS kind, CASE WHEN event_id % 3 = 0 THEN 504 ELSE 502 END AS status, left(repeat(props, 99), 512) AS detail,
'https://host' || event_id % 4 || CASE event_id % 4 WHEN 1 THEN '/api' ELSE '' END || '/v1/chat/completions' AS url FROM events""")
def failed_calls(spark, sf):
    """Calls without an answer: their kind, status and cut detail, and where they went."""
    kind = calls.failure_kind(F.col("event_id") % 3 == 0)
    tail = F.element_at(F.array(*[F.lit(t) for t in ("", "/api//", "/v1", "/v1/")]), (F.col("event_id") % 4 + 1).cast("int"))
    base = F.concat(F.lit("https://host"), (F.col("event_id") % 4).cast("string"), tail)
    return _events(spark, sf).select("event_id", kind.alias("kind"), calls.error_fields(kind)[0].alias("status"), calls.log_detail(F.repeat("props", F.lit(99))).alias("detail"), tenancy.join_url(base, "/chat/completions").alias("url"))


@query(f"""WITH l AS (SELECT event_id AS seq, event_type AS tenant_id, {_SECONDS} AS ts_unix FROM events), w AS (SELECT * FROM l WHERE seq >= 700 ORDER BY seq LIMIT 512),
r AS (SELECT *, sum(new) OVER (ORDER BY seq) AS run FROM (SELECT *, CASE WHEN tenant_id IS NOT DISTINCT FROM lag(tenant_id) OVER (ORDER BY seq) THEN 0 ELSE 1 END AS new FROM w))
SELECT CAST(run AS BIGINT) AS run, any_value(tenant_id) AS tenant_id, count(*) AS n, min(ts_unix) AS period_start, max(ts_unix) + 1 AS period_end FROM r GROUP BY run""")
def pending_batches(spark, sf):
    """The runs of the next flush behind a cursor."""
    ledger = _events(spark, sf).select(F.col("event_id").alias("seq"), F.col("event_type").alias("tenant_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_unix"))
    return ingest.batches(audit.pending(ledger, 700)).select(F.col("run").cast("long").alias("run"), "tenant_id", "n", "period_start", "period_end")


_HEADER = """CASE c_nationkey % 5 WHEN 0 THEN 'Bearer mn_' || c_custkey || '.' || c_name WHEN 1 THEN 'bearer mn_' || c_name || '.up.' || c_custkey
  WHEN 2 THEN 'Bearer mn_.' || c_name WHEN 3 THEN 'Basic ' || c_name ELSE 'Bearer mn_' || c_custkey END"""


@query(rf"""WITH h AS (SELECT c_custkey, c_mktsegment, {_HEADER} AS header FROM customer),
r AS (SELECT *, CASE WHEN lower(header[1:7]) = 'bearer ' THEN trim(header[8:]) END AS rest FROM h),
p AS (SELECT *, strpos(rest, '.') AS dot FROM r),
v AS (SELECT *, coalesce(starts_with(rest, 'mn_') AND dot > 0 AND dot - 1 > 3 AND len(rest) > dot, false) AS valid FROM p)
SELECT c_custkey, valid, CASE WHEN valid THEN rest[1:dot - 1] END AS token, CASE WHEN valid THEN rest[dot + 1:] END AS upstream,
CASE WHEN regexp_full_match(trim(c_mktsegment), '[A-Za-z0-9._-]{{1,64}}') THEN trim(c_mktsegment) ELSE 'default' END AS tenant FROM v""")
def composite_key_parse(spark, sf):
    customer = _t(spark, sf, "customer").withColumn("header", F.expr(_HEADER))
    valid, token, upstream = tenancy.composite_key(F.col("header"))
    return customer.select("c_custkey", valid.alias("valid"), token.alias("token"), upstream.alias("upstream"), tenancy.tenant_of(F.col("c_mktsegment")).alias("tenant"))


@query("SELECT c_custkey, sha256('access-token:' || c_name) AS digest FROM customer")
def token_digest(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", tenancy.digest("access-token:", F.col("c_name")).alias("digest"))


_BODY = "CASE WHEN event_id % 7 = 3 THEN substr(props, 1, length(props) - 1) ELSE props END"
_STATUS = "CASE event_id % 4 WHEN 0 THEN 502 WHEN 1 THEN 200 WHEN 2 THEN 400 ELSE 204 END"


@query(f"SELECT event_id, ({_STATUS} IN (502, 503) OR ({_STATUS} BETWEEN 200 AND 299 AND NOT coalesce(json_valid({_BODY}), false))) AS retry FROM events")
def retry_classify(spark, sf):
    events = _events(spark, sf)
    return events.select("event_id", tenancy.retryable(F.expr(_STATUS), F.expr(_BODY)).alias("retry"))


# --- fakes, vault, call outcomes, stream payloads --------------------------------------------------


def _digit(at: int) -> str:
    return f"(strpos('0123456789abcdef', f[{at}]) - 1)"


@query(f"""WITH {_FOUND}, faked AS (SELECT *, {_hexed("'fake' || chr(31) || kind || chr(31) || value")} AS f FROM put)
SELECT d.doc_id, coalesce(p.t, d.text) AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(s[i] || CASE kind WHEN 'Email' THEN 'user.' || f[1:8] || '@example.org' WHEN 'PhoneSn' THEN '+221 70' || translate(f[1:7], 'abcdef', '012345') ELSE repl END, '' ORDER BY i) || any_value(s[len(s)]) AS t
  FROM faked GROUP BY doc_id) p USING (doc_id)""")
def realistic_fakes(spark, sf):
    return detect.mask(_docs(spark, sf), SECRET, fakes=True).select("doc_id", "text")


_STORED = f"{NOW} - (request_id % 14) * 86400"


@query(f"""WITH {_FOUND}, r AS (SELECT DISTINCT doc_id AS request_id, repl AS token, kind, value FROM put WHERE kind IN ('Email', 'PhoneSn', 'CniSn')),
v AS (SELECT token, max({_STORED}) + 604800 AS expires_at FROM r GROUP BY token)
SELECT request_id, token, kind, CASE WHEN expires_at > {NOW} OR kind = 'PhoneSn' THEN value END AS value FROM r JOIN v USING (token)""")
def vault_fallback(spark, sf):
    """Values of all but phones are asked of the vault, in which some have expired."""
    key = vault.vault_key(SECRET, b"salt")
    book = detect.registry(_docs(spark, sf), SECRET, "doc_id").withColumn("at", F.expr(_STORED))
    asked = book.select("request_id", "token", "kind", F.when(F.col("kind") == "PhoneSn", F.col("value")).alias("value"))
    return vault.fill(asked, vault.put(book, key, "at"), key, NOW)


_KINDS = [e[0] for e in calls.ERRORS]


@query("SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, (_, s, _, _) in enumerate(calls.ERRORS)) + """ END AS status,
'{"error":{"message":"' || event_type || '","type":"' || CASE event_id % 9 """ + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t, _) in enumerate(calls.ERRORS))
       + """ END || '","code":"' || CASE event_id % 9 """ + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, _, c) in enumerate(calls.ERRORS)) + """ END || '"}}' AS body FROM events""")
def error_mapping(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 9 + 1).cast("int"))
    return _events(spark, sf).select("event_id", calls.error_fields(kind)[0].alias("status"), calls.error_body(kind, F.col("event_type")).alias("body"))


_BAD_JSON = calls.BAD_JSON.replace("'", "''")


@query(f"""SELECT event_id, CASE WHEN {_STATUS} BETWEEN 200 AND 299 AND coalesce(json_valid({_BODY}), false) THEN {_BODY} END AS body,
CASE WHEN {_STATUS} NOT BETWEEN 200 AND 299 THEN '{calls.BAD_STATUS}' WHEN NOT coalesce(json_valid({_BODY}), false) THEN '{_BAD_JSON}' END AS error FROM events""")
def upstream_results(spark, sf):
    body, error = calls.result(F.expr(_STATUS), F.expr(_BODY))
    return _events(spark, sf).select("event_id", body.alias("body"), error.alias("error"))


@query("""SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS retry,
'{' || CASE WHEN NOT retry AND event_id % 3 <> 0 THEN '"response_format":{"type":"json"},' ELSE '' END || '"user":' || user_id || '}' AS request FROM events""")
def response_format_degrade(spark, sf):
    """Calls that failed with 400 are sent again without the field, if it was there and was named."""
    sent = F.concat(F.lit("{"), F.when(F.col("event_id") % 3 != 0, '"response_format":{"type":"json"},').otherwise(""), F.lit('"user":'), F.col("user_id").cast("string"), F.lit("}"))
    status = F.when(F.col("event_id") % 2 == 0, 400).otherwise(500)
    answer = F.when(F.col("event_id") % 5 != 0, f"This {calls.NO_RESPONSE_FORMAT} now").otherwise("bad")
    rows = _events(spark, sf).select("event_id", sent.alias("sent"), status.alias("status"), answer.alias("answer"))
    retry = calls.degradable(F.col("status"), F.col("sent"), F.col("answer"))
    return rows.select("event_id", retry.alias("retry"), F.when(retry, calls.without_field(F.col("sent"))).otherwise(F.col("sent")).alias("request"))


@query("""SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE user_id % 10 = 0) AS auth_failures, count(*) FILTER (WHERE event_id % 4 IN (0, 2)) AS upstream_errors,
CAST(sum(event_id % 3) AS BIGINT) AS unresolved, count(*) FILTER (WHERE value > 150) AS quasi_flags FROM events GROUP BY event_type""")
def service_metrics(spark, sf):
    return calls.metrics(_events(spark, sf), F.col("user_id") % 10 == 0, F.expr(f"{_STATUS} NOT BETWEEN 200 AND 299"), F.expr("event_id % 3"), F.col("value") > 150, "event_type")


@query("SELECT c_custkey, c_nationkey % 2 = 0 AND c_nationkey % 3 <> 0 AS by_verifier, c_name = 'Customer#000000007' AS by_token, true AS open FROM customer")
def access_decision(spark, sf):
    told = F.expr("CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey % 2 = 0 END")
    token = F.col("c_name")
    return _t(spark, sf, "customer").select("c_custkey", calls.access(token, told).alias("by_verifier"), calls.access(token, expected="Customer#000000007").alias("by_token"), calls.access(token).alias("open"))


@query("""SELECT event_id, replace(replace(rtrim(to_base64(encode('{"tenant_id":"' || event_type || '","ts_unix":' || floor(epoch(ts))::BIGINT || '}')), '='), '+', '-'), '/', '_') AS header FROM events""")
def receipt_headers(spark, sf):
    receipt = F.to_json(F.struct(F.col("event_type").alias("tenant_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_unix")))
    return _events(spark, sf).select("event_id", T.base64url(receipt).alias("header"))


@query("""SELECT event_id, t AS "text" FROM (SELECT event_id, unnest([event_type, 'q"' || user_id, event_type || ':']) AS t FROM events)""")
def json_string_leaves(spark, sf):
    body = F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.array(F.concat(F.lit('q"'), F.col("user_id").cast("string"))).alias("c"), F.lit(1).alias("n")).alias("b"), F.concat("event_type", F.lit(":")).alias("d")))
    return _events(spark, sf).select("event_id", F.explode(fields.json_strings(body)).alias("text"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best,
round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 9) AS prob FROM embeddings""")
def argmax_softmax(spark, sf):
    best, prob = spans.best_label(F.col("embedding").cast("array<double>"))
    return _t(spark, sf, "embeddings").select("vec_id", best.alias("best"), F.round(prob, 9).alias("prob"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'content' WHEN role = 'user' THEN 'tool' ELSE 'reasoning' END AS channel,
CAST(CASE WHEN role = 'user' THEN turn % 3 ELSE 0 END AS INT) AS idx, text AS delta, 'c' || conv_id AS id FROM conversations WHERE text <> ''""")
def stream_route(spark, sf):
    """Turns as stream payloads, the id in the first of a conversation only; routed, rebuilt and routed again."""
    turns = _t(spark, sf, "conversations")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    call = F.struct((F.col("turn") % 3).cast("int").alias("index"), F.struct(F.col("text").alias("arguments")).alias("function"))
    is_, text = F.col("role"), F.col("text")
    delta = F.struct(F.when(is_ == "assistant", text).alias("content"), F.when(~is_.isin("assistant", "user"), text).alias("reasoning_content"), F.when(is_ == "user", F.array(call)).alias("tool_calls"))
    body = F.struct(F.when(first, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("id"), F.array(F.struct(delta.alias("delta"))).alias("choices"))
    routed = stream_events.route(turns.filter("text <> ''").select("conv_id", "turn", F.to_json(body).alias("payload")), "conv_id", "turn")
    again = routed.select("conv_id", "turn", stream_events.rebuild(F.col("channel"), F.col("idx"), F.col("delta")).alias("payload"))
    return stream_events.route(again, "conv_id", "turn").select("conv_id", "turn", "channel", "idx", "delta", "id")


@query("SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), 0), 0), 5000) AS cursor FROM events")
def cursor_recovery(spark, sf):
    stored = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return _events(spark, sf).select("event_id", audit.recovered_cursor(stored, F.lit(5000).cast("long")).alias("cursor"))
