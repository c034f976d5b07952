import base64
import json

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.operators import audit, calls, detect, fields, spans, vault
from maskloom.streaming import events

KEY = vault.vault_key(b"pass", b"salt")


def test_vault_fills_only_the_registry_and_expires(spark):
    schema = "request_id long, token string, kind string, value string, at long"
    kept = spark.createDataFrame([(1, "t1", "Email", "a", 0), (2, "t1", "Email", "a", 50), (3, "t2", "Email", "b", 0), (4, None, "Email", "c", 0), (5, "t5", "Email", None, 0)], schema)
    box = vault.put(kept, KEY, "at", ttl=100)
    assert {r.token: r.expires_at for r in box.collect()} == {"t1": 150, "t2": 100}
    asked = spark.createDataFrame([(9, "t1", "Email", None), (9, "t2", "Email", None), (9, "t3", "Email", "own")], "request_id long, token string, kind string, value string")
    assert {r.token: r.value for r in vault.fill(asked, box, KEY, 100).collect()} == {"t1": "a", "t2": None, "t3": "own"}
    other = vault.vault_key(b"other", b"salt")
    assert {r.value for r in vault.fill(asked, box, other, 0).collect()} == {None, "own"}
    swapped = box.withColumn("token", F.when(F.col("token") == "t1", "t2").otherwise("t1"))
    assert {r.value for r in vault.fill(asked, swapped, KEY, 0).collect()} == {None, "own"}  # bound to its token
    with pytest.raises(ValueError):
        vault.put(kept, b"short", "at")


def test_fakes_are_stable_and_leak_nothing(spark):
    texts = spark.createDataFrame([(1, "a@b.org and +221 77 123 45 67 and 1234567890128"), (2, "a@b.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in detect.mask(texts, b"k", fakes=True).collect()}
    assert got[2].startswith("user.") and got[2] in got[1] and "+221 70" in got[1] and T.OPEN in got[1] and got[3] is None
    assert "a@b.org" not in got[1] and "123 45 67" not in got[1]
    names = spark.createDataFrame([("Person", "x"), ("nom_sn", "x"), ("CniSn", "x")], "kind string, value string").crossJoin(T.pads(spark, b"k"))
    fakes = {r.kind: r.f for r in names.select("kind", T.fake(F.col("kind"), F.col("value"), F.col("ipad"), F.col("opad")).alias("f")).collect()}
    assert fakes["CniSn"] is None and fakes["nom_sn"] in T.FAMILY and fakes["Person"].split()[0] in T.GIVEN


def test_base64url(spark):
    for text in ("", "a", "ab", "abc", "~~~???é"):
        got = spark.range(1).select(T.base64url(F.lit(text)).alias("b")).first().b
        assert got == base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_outcomes(spark):
    rows = [(200, '{"a":1}', None), (200, '{"a"', calls.BAD_JSON), (204, None, calls.BAD_JSON), (502, "{}", calls.BAD_STATUS)]
    df = spark.createDataFrame([(s, b) for s, b, _ in rows], "s int, b string")
    got = [tuple(r) for r in df.select(*calls.result(F.col("s"), F.col("b"))).collect()]
    assert got == [(b if e is None else None, e) for _, b, e in rows]
    kinds = spark.createDataFrame([(e[0],) for e in calls.ERRORS] + [("Nope",), (None,)], "k string")
    assert [tuple(r) for r in kinds.select(*calls.error_fields(F.col("k"))).collect()] == [e[1:] for e in calls.ERRORS] + [(None,) * 3] * 2
    assert spark.range(1).select(F.length(calls.log_detail(F.repeat(F.lit("é"), F.lit(600)))).alias("n")).first().n == 512


def test_request_ids_and_failures(spark):
    df = spark.range(200).select("id", calls.request_id(F.col("id")).alias("r"), calls.request_id(F.col("id")).alias("again"), calls.failure_kind(F.col("id") == 0).alias("k"))
    got = df.collect()
    assert len({r.r for r in got}) == 200 and all(r.r == r.again and len(r.r) == 8 and r.r.isalnum() and r.r == r.r.lower() for r in got)
    assert got[0].k == "UpstreamTimeout" and {r.k for r in got[1:]} == {"Upstream"}


def test_degrade_needs_both_conditions(spark):
    ask, bare, said = '{"response_format":{"t":"j"},"m":[1,{"x":null}],"s":"q\\"z"}', '{"m":1}', f"x {calls.NO_RESPONSE_FORMAT}"
    rows = [(400, ask, said), (400, bare, said), (400, ask, "other"), (500, ask, said), (400, None, said), (400, "junk", said), (400, ask, None)]
    df = spark.createDataFrame(rows, "s int, r string, a string")
    assert [r[0] for r in df.select(calls.degradable(F.col("s"), F.col("r"), F.col("a"))).collect()] == [True] + [False] * 6
    want = {k: v for k, v in json.loads(ask).items() if k != "response_format"}
    assert json.loads(df.limit(1).select(calls.without_field(F.col("r")).alias("r")).first().r) == want


def test_access_fails_closed(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), (None, None)], "t string, v boolean")
    assert [r[0] for r in df.select(calls.access(F.col("t"), F.col("v"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(calls.access(F.col("t"), expected="a")).collect()] == [True, True, True, False]


def test_json_strings_and_new_texts(spark):
    body = '{"k:":"a:","n":{"x":["b\\"c",1,null,{"y":"\\u27e6d"}]},"messages":[{"role":"user","content":"old"}],"extra":{"z":1}}'
    df = fields.parse(spark.createDataFrame([(1, body), (2, '{"a":'), (3, None), (4, '"solo"')], "id long, body string"))
    got = {r.id: r.s for r in df.select("id", fields.json_strings(F.col("body")).alias("s")).collect()}
    assert got == {1: ["a:", 'b"c', "⟦d", "user", "old"], 2: [], 3: [], 4: ["solo"]}
    new = json.loads(df.filter("id = 1").select(fields.with_texts(F.col("body"), F.create_map(F.lit("0/content/0"), F.lit("new"))).alias("b")).first().b)
    assert new["messages"][0]["content"] == "new" and new["extra"] == {"z": 1} and new["k:"] == "a:"


def test_labels_spans_and_cursor(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([1000.0, 1000.0],), ([],), (None,)], "x array<double>")
    best, prob = spans.best_label(F.col("x"))
    got = df.select(best.alias("b"), prob.alias("p")).collect()
    assert got[0].b == 1 and abs(got[0].p - 0.66524) < 1e-5 and (got[1].b, got[1].p) == (0, 0.5) and got[2].p is None and got[3].p is None
    rows = spark.createDataFrame([("LOC", 0, 3, 9), ("ORG", 0, 3, 9), ("PERSON", 3, 3, 9), ("PERSON", 5, 12, 9)], "kind string, start int, end int, n int")
    assert [r.kind for r in spans.known_kinds(rows, "n").collect()] == ["LOC"]
    stored = spark.createDataFrame([("3",), ("x",), (None,), ("99",), ("-1",)], "c string")
    assert [r[0] for r in stored.select(audit.recovered_cursor(F.col("c"), F.lit(10))).collect()] == [3, 0, 0, 10, 0]


def test_stream_routes(spark):
    def chunk(delta, **more):
        return json.dumps({**more, "choices": [{"delta": delta}]})

    tool = {"tool_calls": [{"index": 1, "function": {"arguments": "{a"}}, {"index": 40, "function": {"arguments": "no"}}]}
    rows = [
        chunk({"role": "assistant"}, id="i", model="m"), chunk({"content": "hi", "reasoning_content": "why"}), chunk(tool), "not json",
        chunk({"tool_calls": [{"function": {"arguments": ""}}]}), '{"choices":[]}', chunk({"content": ""}), chunk({"content": "x"}, id="j"),
    ]
    df = spark.createDataFrame([("r", i, p) for i, p in enumerate(rows)], "k string, seq int, payload string")
    out = events.route(df, "k", "seq").orderBy("seq", "channel").collect()
    assert [(r.seq, r.channel, r.idx, r.id) for r in out] == [
        (0, "pass", 0, "i"), (1, "content", 0, "i"), (1, "reasoning", 0, "i"), (2, "tool", 1, "i"), (4, "pass", 0, "i"), (5, "pass", 0, "i"), (7, "content", 0, "j"),
    ]
    built = events.route(df, "k", "seq").filter("seq = 2").select(events.rebuild(F.col("channel"), F.col("idx"), F.lit("new")).alias("p")).first().p
    want = {"index": 0, "delta": {"tool_calls": [{"index": 1, "function": {"arguments": "new"}}]}, "finish_reason": None}
    assert json.loads(built) == {"id": "i", "object": None, "created": None, "model": "m", "choices": [want]}
