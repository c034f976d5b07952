import hashlib
import hmac
import json
import time
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom import config
from maskloom.operators import audit, detect, fields, ingest, model, restore, session, spans, tenancy
from maskloom.sources.ledger import append_ledger, read_ledger
from maskloom.streaming import sse
from maskloom.streaming.chunks import Scanner, restore_chunks, sse_events

KEY = b"test key"
TEXTS = [
    (1, "write to ana.b@example.org or +221 77 123 45 67, host 10.0.0.1"),
    (2, "é192.168.1.10 and 😀 x@y.fr, card 4111111111111111, not 4111111111111112"),
    (3, "nothing here"), (4, ""), (5, None), (6, "again ana.b@example.org"), (7, "id 1234567890128 "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def token(kind, value):
    body = b32encode(hmac.new(KEY, f"{kind}\x1f{value}".encode(), hashlib.sha256).digest())[:26].decode().lower()
    return f"⟦{body}·{T.TAGS[kind]}⟧"


def test_findings_and_places(docs):
    got = {(r.doc_id, r.kind, r.value, r.start, r.byte_start) for r in detect.detect(docs, "doc_id").collect()}
    assert {(d, k) for d, k, *_ in got} == {(1, "Email"), (1, "PhoneSn"), (1, "Ip"), (2, "Ip"), (2, "Email"), (2, "CreditCard"), (6, "Email"), (7, "CniSn")}
    texts = dict(TEXTS)
    for d, _, value, start, byte_start in got:
        assert texts[d][start : start + len(value)] == value
        assert texts[d].encode()[byte_start:].startswith(value.encode())


def test_no_leak_and_roundtrip(docs):
    masked = detect.mask(docs, KEY)
    book = detect.registry(docs, KEY, "doc_id")
    text = {r.doc_id: r.text for r in masked.collect()}
    assert token("Email", "ana.b@example.org") in text[1] and "10.0.0.1" not in text[1] and "[IP]" in text[1]
    assert "x@y.fr" not in text[2] and "4111111111111112" in text[2] and text[5] is None and text[4] == ""
    back = {r.doc_id: r for r in restore.restore(masked, book, "doc_id").collect()}
    assert back[1].text == TEXTS[0][1].replace("10.0.0.1", "[IP]") and back[1].restored == 2 and back[1].unresolved == 0
    assert back[3].text == "nothing here" and back[5].text is None


def test_fails_loudly(spark, docs):
    book = detect.registry(docs, KEY, "doc_id")
    known = token("Email", "ana.b@example.org")
    forged = "⟦" + "a" * 26 + "·EM⟧"
    rows = [(1, f"ok {known}"), (2, f"other request {known}"), (3, f"a {forged}"), (6, f"cut {known[:9]}")]
    got = {r.doc_id: (r.text, r.unresolved) for r in restore.restore(spark.createDataFrame(rows, "doc_id long, text string"), book, "doc_id").collect()}
    assert got == {1: ("ok ana.b@example.org", 0), 2: ("[REDACTED]", 1), 3: ("[REDACTED]", 1), 6: ("[REDACTED]", 1)}


def test_unknown_detector_is_an_error():
    with pytest.raises(ValueError):
        T.pattern(["Nope"])


def test_windows_and_containment(spark):
    for n, want in ((0, 0), (10, 1), (511, 1), (512, 2), (1000, 3)):
        got = spark.range(1).select(spans.windows(F.lit(n)).alias("w")).first().w
        assert len(got) == want and (not n or (got[0].start == 0 and got[-1].end == n))
    rows = [("a", "Person", 0, 10), ("a", "Person", 0, 10), ("a", "Person", 2, 5), ("a", "Location", 2, 5), ("a", "Person", 8, 12)]
    got = spans.drop_contained(spark.createDataFrame(rows, "k string, kind string, start int, end int"), "k").collect()
    assert {(r.kind, r.start, r.end) for r in got} == {("Person", 0, 10), ("Location", 2, 5), ("Person", 8, 12)}


def test_bio_islands(spark):
    rows = [("a", 0, 0, 3, "B-PER", 0.9), ("a", 1, 3, 6, "I-PER", 0.7), ("a", 2, 7, 9, "I-PER", 0.9), ("a", 3, 9, 9, "I-PER", 0.9), ("a", 4, 9, 12, "B-GPE", 0.6)]
    got = spans.bio_islands(spark.createDataFrame(rows, "k string, pos int, start int, end int, label string, prob double"), "k").collect()
    assert {(r.kind, r.start, r.end) for r in got} == {("Person", 0, 6), ("Person", 7, 9)}


def test_report_and_runs(spark):
    cells = spark.createDataFrame([("s", "Email", 6), ("s", "CniSn", 1), ("t", "Email", 5)], "s string, kind string, n long")
    got = {(r.s, r.kind): (r.n, r.publishable) for r in audit.k_anonymous(cells, 5, "s").collect()}
    assert got == {("s", "Email"): (6, False), ("s", "CniSn"): (0, False), ("t", "Email"): (5, True)}
    with pytest.raises(ValueError):
        audit.k_anonymous(cells, 1, "s")
    with pytest.raises(ValueError):
        audit.in_period(F.col("t"), "yearly", 0)
    rows = spark.createDataFrame([(0, "A", 1), (1, "B", 1), (2, "A", 1)], "seq int, tenant string, p int")
    assert [r.run for r in audit.runs(rows, "tenant", ["seq"], ["p"]).orderBy("seq").collect()] == [1, 2, 3]


def test_keys(spark):
    heads = ["Bearer mn_abc.up.x", "bearer mn_abc.u", "Basic mn_a.b", "Bearer mn_.x", "Bearer mn_abc", "Bearer mn_abc.", "", None]
    valid, tok, up = tenancy.composite_key(F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in heads], "h string").select(valid, tok, up).collect()]
    assert got[:2] == [(True, "mn_abc", "up.x"), (True, "mn_abc", "u")] and not any(g[0] for g in got[2:])


def test_nested_fields(spark):
    body = '{"model":"m","x":1,"messages":[{"role":"user","content":"hi"},{"role":"user","content":[{"type":"text","text":"p"},{"type":"image"}]},{"role":"assistant","content":null,"reasoning_content":"r","tool_calls":[{"id":"1","type":"function","function":{"name":"f","arguments":"{\\"a\\":1}"}}]}]}'
    df = fields.parse(spark.createDataFrame([(1, body), (2, "no json"), (3, '{"a":1}')], "id long, body string"))
    assert {r.id: r.error for r in df.collect()} == {1: None, 2: "BadRequest", 3: "BadRequest"}
    got = [(r.msg_idx, r.channel, r.text) for r in fields.chat_fields(df, "id").orderBy("msg_idx", "leaf_idx").collect()]
    assert got == [(0, "content", "hi"), (1, "part", "p"), (2, "reasoning", "r"), (2, "tool_args", '{"a":1}')]


def test_ledger_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"tenant_id":"a","ts_unix":1}\n\n{"tenant_id":\n{"tenant_id":"b","ts_unix":2,"more":1}\n')
    assert {r.tenant_id for r in read_ledger(spark, str(tmp_path / "l.jsonl")).collect()} == {"a", "b"}


def test_chunks_of_any_size_give_the_whole_text():
    a, b = token("Email", "a@b.c"), token("PhoneSn", "+1")
    book, body = {a: "a@b.c", b: "+1"}, a[1:27]
    text = f"x {a}{b} yabc {a} {body} {body}x x{body} {'z' * 40} {body}. ⟦half and more, {a}⟧ end {a[:9]}"
    want = "x a@b.c+1 yabc a@b.c a@b.c " + f"{body}x x{body} {'z' * 40} a@b.c. [REDACTED] and more, a@b.c[REDACTED] end [REDACTED]"
    for n in range(1, len(text) + 1):
        s = Scanner(book)
        got = "".join(s.push(text[i : i + n]) for i in range(0, len(text), n)) + s.finish()
        assert got == want and (s.restored, s.unresolved) == (6, 3)
    s = Scanner(book)
    assert s.push("q " + a[:9]) == "q " and s.finish() == "[REDACTED]" and s.unresolved == 1


def run(stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_of_unordered_chunks(spark, tmp_path):
    a = token("Email", "a@b.c")
    text = f"hello {a} bye"
    schema, book = "request_id string, seq long, channel string, idx int, delta string, done boolean", "request_id string, token string, value string"

    def put(request, registry):
        parts = [(request, k, "content", 0, text[i : i + 7], i + 7 >= len(text)) for k, i in enumerate(range(0, len(text), 7))]
        spark.createDataFrame(parts[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.createDataFrame(registry, book).coalesce(1).write.mode("append").parquet(str(tmp_path / "book"))

    def again():
        out = restore_chunks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.readStream.schema(book).parquet(str(tmp_path / "book")), idle_ms=None)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    put("r", [("r", a, "a@b.c")])
    again()
    put("later", [("later", None, None), ("other", a, "x")])  # a request that begins after the query did
    again()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert "".join(r.text for r in rows if r.request_id == "r") == "hello a@b.c bye"
    assert "".join(r.text for r in rows if r.request_id == "later") == "hello [REDACTED] bye"
    assert sum(r.unresolved for r in rows) == 1 and sum(r.restored for r in rows) == 1


def test_relay_equals_whole_restoration_for_every_cut():
    a = token("Email", "a@b.c")
    say = lambda d, **m: "data: " + json.dumps({**m, "choices": [{"index": 0, "delta": d}]}, ensure_ascii=False) + "\n\n"
    raw = say({"role": "assistant"}, id="i", model="m")
    raw += "".join(say({"content": c}) for c in (f"to {a[:5]}", a[5:20], f"{a[20:]} ok")) + say({"reasoning_content": "why"}) + ": note\n\n" + "data: {bad\n\n"
    raw += say({"tool_calls": [{"index": 1, "function": {"name": "f", "arguments": ""}}]}) + say({"tool_calls": [{"index": 1, "function": {"arguments": a}}, {"index": 40, "function": {"arguments": "no"}}]})
    raw += "data: [DONE]\n\n"
    for n in (1, 2, 3, 7, 50, len(raw)):
        r = sse.Relay({a: "a@b.c"})
        events = [e for i in range(0, len(raw), n) for e in r.push(raw[i : i + n])] + r.finish()
        assert events[-1] == "[DONE]" and (r.restored, r.unresolved) == (2, 0)
        bodies = [json.loads(e) for e in events[:-1]]
        deltas = [b["choices"][0]["delta"] for b in bodies]
        assert "".join(d.get("content", "") for d in deltas) == "to a@b.c ok" and "".join(d.get("reasoning_content", "") for d in deltas) == "why"
        assert [c["function"]["arguments"] for d in deltas for c in d.get("tool_calls", [])] == ["", "a@b.c"]
        assert deltas[0] == {"role": "assistant"} and all(b["id"] == "i" for b in bodies if "content" in b["choices"][0]["delta"])
    r = sse.Relay({}, frame=100)
    assert r.push("data: {\"choices\":[]}" + " " * 200) == ['{"choices":[]}' + " " * 200] and r.rest == ""


def test_audit_stream_passes_unchanged_and_closes_with_a_receipt(spark, tmp_path):
    text = f"x {token('Email', 'a')} y ⟦bad⟧ z"
    rows = [("q", k, text[i : i + 5], i + 5 >= len(text)) for k, i in enumerate(range(0, len(text), 5))]
    schema = "request_id string, seq long, data string, done boolean"
    spark.createDataFrame(rows[::-1], schema).write.parquet(str(tmp_path / "in"))
    run(sse.relay(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), audit=True, idle_ms=None), tmp_path / "cp", "audited")
    got = spark.sql("SELECT * FROM audited ORDER BY seq").collect()
    assert "".join(r.event for r in got if r.kind == "piece") == text
    assert [json.loads(r.event) for r in got if r.kind == "receipt"] == [{"incomplete_restorations": 1, "blocked_outputs": 1}]


def test_relay_stream_to_a_sink(spark, tmp_path):
    a = token("Email", "a@b.c")
    raw = "data: " + json.dumps({"choices": [{"delta": {"content": f"hi {a}"}}]}, ensure_ascii=False) + "\n\n"
    schema, book = "request_id string, seq long, data string, done boolean", "request_id string, token string, value string"
    spark.createDataFrame([("q", 0, raw[:30], False), ("q", 1, raw[30:], True)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("q", a, "a@b.c")], book).write.parquet(str(tmp_path / "book"))
    out = sse.relay(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.readStream.schema(book).parquet(str(tmp_path / "book")), idle_ms=None)
    sse.write_events(out, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    events = spark.read.json(str(tmp_path / "out"))
    lines = [r.line for r in sse.sse_lines(events).orderBy("seq").collect()]
    assert lines[-1] == "data: [DONE]\n\n" and "".join(json.loads(x[6:])["choices"][0]["delta"]["content"] for x in lines[:-1]) == "hi a@b.c"
    assert sse.finish_stats(events).first().restored == 1


def test_sse_framing():
    assert sse_events("data: a\ndata: b\n\nid: 1\n\ndata: c") == (["a\nb"], "data: c")


def test_long_runs_cost_one_pass(spark):
    texts = spark.createDataFrame([(1, "a" * 1_000_000), (2, "7" * 1_000_000), (3, "a@" + "b." * 300_000), (4, "x" * 500_000 + "@y.org"), (5, "a@b.com.x1@y.org 2024-01-05 v2024-13-05")], "doc_id long, text string")
    detect.detect(texts.limit(0), "doc_id").collect()
    began = time.time()
    got = [(r.doc_id, r.kind, len(r.value)) for r in detect.detect(texts.filter("doc_id <> 2"), "doc_id").collect()]
    assert time.time() - began < 20 and {g for g in got} == {(4, "Email", 500_006), (5, "Email", 7), (5, "Email", 9), (5, "Date", 10)}


def test_many_matches_have_their_places(spark):
    text = "".join(f"é{'x' * (k % 7)} u{k}@x.org " for k in range(900))
    got = detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").collect()
    assert len(got) == 900 and all(text[r.start : r.end] == r.value and text.encode()[r.byte_start :].startswith(r.value.encode()) for r in got)


def test_outside_spans_win_over_fragments(spark):
    text = "Aminata Diop <ana@x.org> and Diop, é Dakar"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    at = text.index("Dakar")
    rows = [(1, "Person", 0, 12), (1, "nom_sn", 8, 12), (1, "nom_sn", 29, 33), (1, "Person", 16, 19), (1, "ville_sn", at, at + 5), (1, "Person", 5, 5), (1, "Person", 10, 900), (2, "Person", 0, 3), (9, "Person", 0, 3)]
    outside = spark.createDataFrame(rows, "doc_id long, kind string, start long, end long")
    found = detect.all_spans(df, "doc_id", outside)
    assert {(r.kind, r.value) for r in found.collect()} == {("Person", "Aminata Diop"), ("Email", "ana@x.org"), ("nom_sn", "Diop"), ("ville_sn", "Dakar")}
    masked, book = detect.mask_spans(df, found, KEY, "doc_id", places=True)
    got = {r.doc_id: r.text for r in masked.collect()}
    assert got[2] is None and got[3] == "plain" and got[1].endswith("é [VILLE_SN]") and not any(x in got[1] for x in ("Diop", "ana@", "Dakar"))
    back = {r.doc_id: r.text for r in restore.restore(masked, book, "doc_id").collect()}
    assert back[1] == text.replace("Dakar", "[VILLE_SN]")
    assert {r.value for r in detect.all_spans(df, "doc_id").collect()} == {"ana@x.org"}  # no producer: the detectors alone


def test_session_aliases_are_masked_while_remembered(spark):
    turns = [(1, 1, "Mamadou came with Awa"), (2, 1, "then Momo and MAMADOU left, she too"), (3, 1, "Binta Coumba Demba"), (4, 1, "momo Momo awa binta"), (5, 2, "Momo Senegal")]
    table = spark.createDataFrame([(k, s, k, t) for k, s, t in turns], "k long, s long, at long, text string")
    names = spark.createDataFrame([(n, "nom_sn") for n in ("Mamadou", "Awa", "Binta", "Coumba", "Demba", "Senegal")], "name string, kind string")
    land = spark.createDataFrame([("Senegal",)], "name string")
    masked, book = session.session_mask(table, KEY, "k", "s", "at", names, whitelist=land, keep=3)
    got = {r.k: r.text for r in masked.collect()}
    assert "Momo" not in got[2] and "MAMADOU" not in got[2] and "she too" in got[2] and "Mamadou" not in got[1]
    assert got[4].startswith("momo Momo awa ") and "binta" not in got[4]  # three later names pushed the first two out
    assert got[5] == "Momo Senegal"
    assert {r.text for r in restore.restore(masked.select("k", "text"), book, "k").collect()} == {t for _, _, t in turns}


def test_requests_and_responses_in_place(spark):
    body = '{"model":"m","x":{"y":[1,null]},"messages":[{"role":"user","content":[{"type":"text","text":"a@b.org"},{"type":"image_url","image_url":{"url":"u@v.org"}}],"extra":1},{"role":"assistant","content":null,"reasoning_content":"r@b.org","tool_calls":[{"id":"1","type":"function","function":{"name":"f","arguments":"{\\"a\\":\\"t@b.org\\"}"}}]}]}'
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, '{"messages":[]}')], "id long, body string")
    masked, book = fields.mask_requests(df, "id", KEY)
    got = {r.id: r for r in masked.collect()}
    new = json.loads(got[1].body)
    assert got[2].error == "BadRequest" and got[2].body is None and json.loads(got[3].body) == {"messages": []}
    assert new["x"] == {"y": [1, None]} and new["messages"][0]["content"][1] == {"type": "image_url", "image_url": {"url": "u@v.org"}} and new["messages"][0]["extra"] == 1
    assert new["messages"][0]["content"][0]["text"] == token("Email", "a@b.org") and json.loads(new["messages"][1]["tool_calls"][0]["function"]["arguments"]) == {"a": token("Email", "t@b.org")}
    answers = [(1, json.dumps({"id": "z", "choices": [{"message": m, "finish_reason": "stop"} for m in new["messages"]]}, ensure_ascii=False)), (4, '{"choices":5}'), (5, "raw"), (6, None)]
    more = book.unionByName(book.withColumn("value", F.lit(None).cast("string")))  # a token twice, once without its value
    done = {r.id: r for r in restore.restore_responses(spark.createDataFrame(answers, "id long, body string"), more, "id").collect()}
    assert (done[1].restored, done[1].unresolved) == (3, 0)
    back = json.loads(done[1].body)
    assert [c["message"] for c in back["choices"]] == json.loads(body)["messages"] and back["id"] == "z" and back["choices"][0]["finish_reason"] == "stop"
    assert done[4].body == '{"choices":5}' and done[5].body == "raw" and done[6].body is None
    audit_order = [r.channel for r in fields.audit_fields(fields.parse(df), "id").orderBy("msg_idx", "leaf_idx").collect()]
    assert audit_order == ["part", "tool_args", "reasoning"]
    long = fields.parse(spark.createDataFrame([(1, '{"messages":[]}' + " " * 50)], "id long, body string"), longest=20).first()
    assert long.error == "TooLarge"


def test_receipts_reports_and_seals(spark, tmp_path):
    reqs = spark.createDataFrame([(1, "t", "s", 100), (2, "t", "s", 9000)], "id long, tenant_id string, session_ref_hashed string, ts_unix long")
    found = spark.createDataFrame([(1, "Email")] * 3 + [(1, "Ip"), (2, "Email"), (2, "CniSn")], "id long, kind string")
    answers = spark.createDataFrame([(1, 2, 1)], "id long, incomplete_restorations long, blocked_outputs long")
    rows = audit.sealed(audit.full_receipts(reqs, found, answers, "id", {"k": 5, "a": [1]}), KEY)
    assert [r.valid for r in audit.verified(rows, KEY).collect()] == [True, True]
    assert not any(r.valid for r in audit.verified(rows.withColumn("ts_unix", F.col("ts_unix") + 1), KEY).collect()) and not any(r.valid for r in audit.verified(rows, b"other").collect())
    assert audit.policy_hash({"a": 1, "b": 2}) == audit.policy_hash({"b": 2, "a": 1}) != audit.policy_hash({"a": 1})
    append_ledger(rows.drop("id", "sig_agent"), str(tmp_path / "ledger"))
    back = read_ledger(spark, str(tmp_path / "ledger"))
    assert {(r.ts_unix, r.counters.masked_by_type["Email"], r.counters.blocked_outputs) for r in back.collect()} == {(100, 3, 1), (9000, 1, 0)}
    r = audit.period_report(back, "all", 9000, 2).first()
    assert (r.period_start, r.period_end, r.total_requests, r.redacted, r.publishable) == (100, 9001, 2, {"Email": 4, "CniSn": 0}, False)
    r = audit.period_report(back, "hourly", 9000, 2).first()
    assert (r.period_start, r.period_end, r.total_requests, r.redacted) == (5400, 9001, 1, {"Email": 0, "CniSn": 0})
    r = audit.period_report(back.limit(0), "all", 50, 2).first()
    assert (r.period_start, r.period_end, r.total_requests, r.redacted, r.publishable) == (0, 51, 0, {}, False)


def test_ingest_stops_at_the_first_failure_and_goes_on_from_there(spark, tmp_path):
    ledger = spark.createDataFrame([(k, t, 100 + k) for k, t in enumerate(["a", "a", "b", "a", "c"])], "seq long, tenant_id string, ts_unix long")
    cursor, sent = ingest.Cursor(spark, f"file://{tmp_path}/cursor"), []

    def send(r):
        if r.tenant_id == "b" and len(sent) < 2:
            sent.append("tried")
            raise OSError
        sent.append((r.tenant_id, r.n, r.period_start, r.period_end))
        return True

    assert ingest.flush(ledger, cursor, send) == 2 and cursor.read(9) == 2 and sent == [("a", 2, 100, 102), "tried"]
    assert ingest.flush(ledger, cursor, send, limit=2) == 2 and cursor.read(3) == 3
    assert ingest.flush(ledger, cursor, send) == 1 and ingest.flush(ledger, cursor, send) == 0 and sent[-1] == ("c", 1, 104, 105)
    (tmp_path / "broken").write_text("x")
    assert ingest.Cursor(spark, f"file://{tmp_path}/broken").read(5) == 0
    ticks = tmp_path / "ticks"
    ledger.write.parquet(str(ticks))
    cursor.write(0)
    stream = spark.readStream.schema(ledger.schema).parquet(str(ticks))
    ingest.flush_forever(stream, lambda: ledger, cursor, lambda r: True, str(tmp_path / "cp"), limit=2, once=True).awaitTermination()
    assert cursor.read(9) == 5


def test_tenants_are_apart_and_purges_hold(spark):
    made = spark.createDataFrame([("a", "d", True, 100), ("b", "e", True, 100), ("a", "f", True, 10)], "tenant string, digest string, valid boolean, at long")
    polls = spark.createDataFrame([("a", 2, 90), ("a", 1, 95), ("b", 1, 90), ("b", 2, 150)], "tenant string, version int, at long")
    live = tenancy.live_decisions(made, polls, 300, 200)
    assert {(r.tenant, r.digest) for r in live.collect()} == {("a", "d")}
    asked = spark.createDataFrame([("a", "d"), ("b", "d"), ("b", "e"), ("a", None)], "tenant string, digest string")
    assert {(r.tenant, r.digest): r.accepted for r in tenancy.accepted(asked, live).collect()} == {("a", "d"): True, ("b", "d"): False, ("b", "e"): False, ("a", None): False}
    refs = [r[0] for r in asked.select(tenancy.session_ref(F.col("tenant"), F.col("digest"))).collect()]
    assert len(set(refs)) == 4 and refs[3] is None and len(refs[0]) == 64


def test_model_spans(spark):
    def load():
        import numpy as np

        def tokenise(text):
            return [(m.start(), m.end()) for m in __import__("re").finditer(r"\S+", text)]

        def infer(text, tokens):
            return np.array([[5.0, 0, 0] if text[a].isupper() else [0, 0, 5.0] for a, _ in tokens])

        return tokenise, infer

    text = " ".join("Ana" if k % 9 == 0 else "word" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, " "), (3, None)], "id long, text string")
    got = model.model_spans(df, "id", load, {0: "b-per", 1: "B-LOC"}, longest=10, overlap=3).collect()
    assert sorted(text[r.start : r.end] for r in got) == ["Ana"] * 5 and {r.kind for r in got} == {"Person"}
    assert model.model_spans(df, "id", lambda: 1 / 0, {}).collect() == [] and model.label_map("/nowhere") == {}
    assert [len(model.windows_of(n)) for n in (0, 10, 511, 512, 1000)] == [0, 1, 1, 2, 3]


def test_settings(tmp_path):
    env = {"MASKLOOM_TENANT_KEY": "ab" * 32, "MASKLOOM_AUDIT_K": "1", "MASKLOOM_REALISTIC_FAKE": "yes", "MASKLOOM_DISABLED": "Ip, Email"}
    s = config.load(env)
    assert s.audit_k == 2 and s.realistic_fake and s.disabled == ("Ip", "Email") and s.geo_whitelist and "ab" * 9 not in repr(s) and "tenant_key" not in s.policy()
    for bad in ({"MASKLOOM_TENANT_KEY": "ab"}, {}, env | {"MASKLOOM_AUDIT": "maybe"}, env | {"MASKLOOM_DISABLED": "Nope"}, env | {"MASKLOOM_STREAM_TOKEN": "300"}, env | {"MASKLOOM_VAULT_TTL": "x"}):
        with pytest.raises(ValueError):
            config.load(bad)
    salt = config.key_file(str(tmp_path / "salt"), 16)
    assert len(salt) == 16 and config.key_file(str(tmp_path / "salt"), 16) == salt and (tmp_path / "salt").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        config.key_file(str(tmp_path / "salt"), 32)
    assert config.passphrase(lambda: "k", {}) == "k" and config.passphrase(lambda: 1 / 0, {"MASKLOOM_PASSPHRASE": "e"}) == "e"
    with pytest.raises(ValueError):
        config.passphrase(None, {"MASKLOOM_PASSPHRASE": " "})
