import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskloom.llm import ann, bytebpe, chat, embedding_dedup, hmm, line_dedup, packing, stages, token_files, toxicity
from maskloom.llm.wordcache import CachedTokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(RANKS, "rb") as f:
    CODER = bytebpe.ByteBpe(bytebpe.parse_ranks(f.read()))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
ODD = [(1, "a  b\n\n'tis don't\t é½ 漢字!!"), (2, ""), (3, None), (3, "x"), (3, "x"), (None, "null key"), (4, "z" * 20_000)]
DOCS = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_bpe_as_the_library_on_any_unicode(texts):
    got = list(CODER.encode(texts))
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODER.decode(i) for i in got] == [t.encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("  \n\t'srtemdvlLé9½漢!?-\x85\x1c　😀")), max_size=5))
def test_bpe_as_the_library(texts):
    got = list(CODER.encode(texts))
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODER.decode(i) for i in got] == [t.encode() for t in texts]


def test_long_merges():
    for t in ("a" * 5000, "ab" * 3000 + "!" * 999, " " * 3000, "é" * 777):
        assert next(iter(CODER.encode([t]))) == LIBRARY.encode_ordinary(t)


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k", True), ("word_bpe_49k", False)])
def test_cached_tokenizer_as_the_library(name, spaces):
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        definition = f.read()
    rng = random.Random(1)
    texts = ["".join(rng.choice("  \n\t'srteL é9½漢!?-\x85ΣßİI<|>́") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", " <|ENDofText|> x", "<|startoftext|>\n<|endoftext|> <|end", "plain | < words"]
    for added in (True, False):
        library = Tokenizer.from_str(definition)
        library.encode_special_tokens = not added
        got = CachedTokenizer(definition, spaces, added).encode(texts)
        assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = bytebpe.encode(docs, RANKS).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((d or 0, LIBRARY.encode_ordinary(t or "")) for d, t in ODD)
    ids = CODER.encode(["é漢 and more 😀"]).__next__()
    raw, at = "é漢 and more 😀".encode(), CODER.offsets(ids)
    assert all(CODER.decode(ids, at, a, b) == raw[a:b] for a in range(len(raw) + 1) for b in range(len(raw) + 2))
    back = bytebpe.decode(bytebpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((d or 0, (t or "").encode()) for d, t in ODD)
    assert bytebpe.encode(spark.createDataFrame([], DOCS), RANKS).collect() == []


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(ODD, DOCS)
    tok = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", tok, frame_bytes=64)
    rows = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 3, 4]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and bytes(r.ids)[-4:] == b"\0\0\0\0" for r in rows)
    assert {r.doc_id for r in token_files.read_token_files(spark, manifest, [1, 4]).collect()} == {1, 4}
    empty = token_files.write_token_files(spark.createDataFrame([], DOCS), f"file://{tmp_path}/e", tok)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_reader_opens_only_what_it_needs_and_sees_damage():
    out = io.BytesIO()
    w = token_files.TokenFileWriter(out, frame_bytes=16)
    for d in range(9):
        w.add(d, np.arange(d + 1, dtype="<u4").tobytes())
    w.close()
    reader = token_files.TokenFileReader(io.BytesIO(out.getvalue()))
    opened, inner = [], reader.frame
    reader.frame = lambda i: opened.append(i) or inner(i)
    assert [(d, np.frombuffer(x, "<u4").tolist()) for d, _, x in reader.documents({5})] == [(5, [0, 1, 2, 3, 4, 5])] and len(opened) == 1
    bad = bytearray(out.getvalue())
    bad[6] ^= 255
    with pytest.raises(Exception):
        list(token_files.TokenFileReader(io.BytesIO(bytes(bad))).documents())


def test_packing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame(ODD + [(100 + d, "word " * rng.randrange(1, 90)) for d in range(300)], DOCS)
    tok = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, tok, 64).toPandas()
    library, want = Tokenizer.from_file(tok), []
    for d, t in ODD + [(100 + d, None) for d in range(0)]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(-1 if d is None else d, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    odd = rows[rows["doc_id"].isna() | (rows["doc_id"] < 100)].fillna({"doc_id": -1})
    assert sorted(odd[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == sorted(want)
    total = rows["length"].sum()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.cumsum([0] + g["length"].tolist())[:-1].tolist() and g["length"].sum() <= 64
    assert rows["sequence_id"].nunique() <= -(-total // 64) + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_genetic_algorithm_beats_its_start():
    rng = np.random.default_rng(4)
    sizes = rng.integers(300, 700, 120).tolist() + [500] * 9  # ties
    island = packing.Island(sizes, 1000, 1)
    start = island.best()[0]
    island.evolve(60)
    score, bins, loads = island.best()
    assert island.crossed > 0 and score < start and sorted(i for b in bins for i in b) == list(range(129)) and max(loads) <= 1000
    assert sorted(map(sorted, packing.listed(packing.numbered(bins, 129)))) == sorted(map(sorted, bins))


def test_islands_cross_and_reach_few_bins(spark):
    rng = random.Random(9)
    pieces = spark.createDataFrame([(d, 0, 0, min(2048, 1 + int(rng.expovariate(1 / 500))), 0, d) for d in range(3000)], packing.PIECES)
    shards = packing.evolve_shards(pieces.withColumn("part", F.lit(0)).withColumn("shard", (F.col("doc_id") % 3).cast("int")), 2048, 2, 2, 12).collect()
    assert len(shards) == 3 and all(len(r.best) == 2 for r in shards)
    firsts = packing.evolve_shards(pieces.withColumn("part", F.lit(0)).withColumn("shard", (F.col("doc_id") % 3).cast("int")), 2048, 2, 1, 12).collect()
    assert all(r.crossed > 0 for r in firsts)
    least = sum(-(-sum(x.length for x in r["items"]) // 2048) for r in shards)
    assert sum(min(len(packing.listed(p)) for p in r.best) for r in shards) <= least + 3


def test_chat(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (None, 0, None, None), (2, 1, "a\nb\\", "x\\"), (2, 1, "a\nb\\", "x\\")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(100)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert got[1].loss_chars == len(odd) and got[3].n_turns == 100 and got[None].n_turns == 1 and got[2].n_turns == 2
    assert not any(r.rewrites for r in chat.format_conversations(table).collect())
    import hashlib

    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(1, 100, 2)).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(table.limit(0))).collect() == []


def test_black_box_templates():
    turns = [("user", str(k)) for k in range(80)]
    shows_last = lambda ts: "".join(f"[{r}:{t}]" for r, t in ts[:-1]) + "".join(f"<{t}>" for _, t in ts[-1:])
    assert all(rewritten for _, rewritten in [*chat.spans(turns[:30], shows_last), *chat.whole_spans(turns, shows_last)][1:30])
    counts = lambda ts: "".join(f"{k}{t};" for k, (_, t) in enumerate(ts))
    with pytest.raises(chat.LooksBack):
        list(chat.spans(turns, counts))
    assert "".join(s for s, _ in chat.whole_spans(turns, counts)) == counts(turns)


def test_templates_that_look_far_back(spark):
    shown = lambda ts: "".join(f"[{r}:{t}]" for r, t in ts)

    def recent(ts):
        return shown(ts[-40:])

    def system_last(ts):
        system = "".join(t for r, t in ts if r == "system")
        users = [k for k, (r, _) in enumerate(ts) if r == "user"]
        return shown([(r, system + t if k == users[-1] else t) if users else (r, t) for k, (r, t) in enumerate(ts) if r != "system"])

    turns = [("system", "S")] + [(("user", "assistant")[k % 2], str(k)) for k in range(99)]
    table = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (recent, system_last):
        got = [(r.span, r.rewrites) for r in chat.format_conversations(table, template).orderBy("turn_no").collect()]
        for k, (span, rewrites) in enumerate(got):
            before, now = template(turns[:k]), template(turns[: k + 1])
            assert now.endswith(span) and rewrites == (not now.startswith(before))
            assert rewrites or before + span == now
        assert any(rewrites for _, rewrites in got[41:])


def test_line_dedup(spark):
    line = "this very line is on sites"
    rows = [(d, f"own words of document {d}\n{line}\nshort", f"s{d % 6}", d) for d in range(12)]
    rows += [(50, line, "s9", 1), (51, None, "s9", 1), (52, "", None, 1), (None, line, "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h1 int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, removed_col="gone").collect()}
    assert line in got[0].text and got[0].gone == 0 and got[3].text == "own words of document 3" and got[3].h1 == 3
    assert got[50].text == "" and got[51].text is None and got[52].text == "" and got[None].text == ""
    assert line_dedup.dedup_lines(docs, min_sites=9).filter(F.contains("text", F.lit(line))).count() == 14
    assert {r.text for r in line_dedup.dedup_lines(docs, min_words=3).filter("doc_id = 3").collect()} == {"own words of document 3\nshort"}
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    long = "y" * 3_000_000  # one very long line on five sites, in rows of one id, of no id, and repeated
    rows = [(1, long, "a", 0), (1, long, "b", 0), (2, "x\n" + long, "c", 0), (None, long, "d", 0), (None, "z\n" + long, "e", 0), (2, "x\n" + long, "c", 0)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, h1 int")).collect()
    assert sorted((r.doc_id or 9, r.text[:9], len(r.text)) for r in got) == [(1, "y" * 9, 3_000_000)] * 2 + [(2, "x", 1)] * 2 + [(9, "", 0), (9, "z", 1)]


def test_pipeline_cuts_spread_lines_of_any_length(spark):
    short = ["Les.", "漢字だけの長い行です", "a\tb", "two\u00a0words"]
    rows = [(d, "\n".join([f"own {d}", "", " ", "\u00a0\t", *short, "few" if d < 4 else "none"]), f"s{d}", 0) for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in stages.cut_spread_lines(spark, docs, "").collect()}
    assert got[0].text == rows[0][1] and got[3].text == "own 3\n\n \n\u00a0\t\nfew" and got[3].n_chars == len(got[3].text)
    assert got[4].text == "own 4\n\n \n\u00a0\t\nnone"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 16))
    x = centre[rng.integers(0, 12, 400)] + rng.standard_normal((400, 16)) * rng.choice([0.01, 0.2, 0.3], 400)[:, None]
    x[50:60] = x[49]
    lab = rng.integers(0, 2, 400)
    rows = [(i, x[i].astype("f4").tolist(), int(lab[i])) for i in range(400)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, rows[3][1], None), (504, [None] * 16, 0), (3, rows[3][1], rows[3][2])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows), most=64).collect()}
    y = x.astype("f4").astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = (y @ y.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(400, dtype=bool)
    comp = np.arange(400)
    for _ in range(400):
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    assert all(got[i] == (link[i].sum(), comp[i], comp[i] == i) for i in range(400))
    assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503, 504))
    assert embedding_dedup.near_vectors(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3])
def test_embedding_dedup_of_few_components(spark, size):
    x = np.random.default_rng(5).standard_normal((60, size)).astype("f4")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(vectors(spark, [(i, x[i].tolist(), 0) for i in range(60)])).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert [got[i] for i in range(60)] == ((y @ y.T >= 0.93).sum(1) - 1).tolist()


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype("f4")
    x[200:400] = x[100]
    rows = [(i, x[i].tolist(), 0) for i in range(1500)] + [(5000, None, 0), (5050, [0.0] * 16, 0), (None, x[0].tolist(), 0)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, most=128).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -2)
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & set(np.lexsort((np.arange(1500), -s[q].round(12)))[:5]))
    assert hits >= 0.9 * 150
    assert sorted(r.vec_id for r in got if r.query_id == 200) == [100, 201, 202, 203, 204]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    few = ann.search(vectors(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    copies = [r for r in got if 200 <= r.query_id < 400 or r.query_id == 100]
    assert len(copies) == 25 and all(r.score > 1 - 1e-12 and r.vec_id != r.query_id for r in copies)


def test_ann_of_several_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(n).tolist()) for n, lo in ((1, 0), (3, 100), (8, 200)) for i in range(lo, lo + 40)]
    rows += [(300, [1e300, 1e300, 1e-300]), (301, [2e300, 2e300, 0.0]), (302, [float("inf"), 1.0, 1.0]), (303, [float("nan")] * 3), (304, [None, 1.0, 1.0]), (7, rows[7][1]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, e, 1, 1) for i, e in rows], "vec_id long, embedding array<double>, q int, cell int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(table, F.col("vec_id") % 50 == 0, share=1.0).collect()}
    good = {i: np.array(e) / np.abs(e).max() for i, e in rows if i < 302}
    for q in (0, 100, 200, 300):
        x = good[q] / np.linalg.norm(good[q])
        want = sorted((-round(float(x @ (e / np.linalg.norm(e))), 9), i) for i, e in good.items() if len(e) == len(x) and i != q)[:5]
        assert [got[q, k + 1][0] for k in range(5)] == [i for _, i in want]
        assert np.allclose([got[q, k + 1][1] for k in range(5)], [-s for s, _ in want])
    assert len(got) == 20


def test_embedding_dedup_with_structure_keeps_doubles_and_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 8)) * np.array([30, 20, 9, 9, 1, 1, 0.1, 0.1])  # cells prune here
    assert not embedding_dedup.Layout(x / np.linalg.norm(x, axis=1)[:, None], 0.001).merged
    x[300:400] = x[200:300] * rng.uniform(0.5, 2, (100, 1)) + rng.standard_normal((100, 8)) * 1e-4
    rows = [(i, x[i].tolist(), 1, 2) for i in range(500)] + [(600, [1e300, 1e300], 1, 2), (601, [2e300, 2e300], 1, 2), (602, [float("inf"), 1.0], 1, 2), (603, [1.0, -0.5], 1, 2), (604, [], 1, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell int")
    for cosine, most in ((0.9995, 4096), (0.9995, 50), (0.93, 4096)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table, cosine, most).collect()}
        y = x / np.linalg.norm(x, axis=1)[:, None]
        assert [got[i][0] for i in range(500)] == ((y @ y.T >= cosine).sum(1) - 1).tolist()
        assert got[600] == got[601] == (1, 600) and got[602] == (0, 602) and got[604] == (0, 604)


def test_forward_equals_all_paths_and_training_raises_likelihood():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    docs = [rng.integers(0, 5, n) for n in (1, 4, 7, 2)]
    for d, got in zip(docs, hmm.forward(m, docs)):
        a = m.start * m.emit[d[0]]
        for s in d[1:]:
            a = (a @ m.move) * m.emit[s]
        assert np.isclose(got, np.log10(a.sum()))
    last = -np.inf
    for _ in range(4):
        counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        hmm.expected(m, docs, counts)
        assert np.isclose(counts[2].sum(), sum(map(len, docs))) and np.isclose(counts[1].sum(), sum(len(d) - 1 for d in docs))
        now = hmm.forward(m, docs).sum()
        assert now >= last - 1e-9
        last, m = now, hmm.Model(counts[0] / counts[0].sum(), counts[1] / counts[1].sum(1, keepdims=True), counts[2] / counts[2].sum(0))


def test_hmm_scores(spark):
    rows = [(d, " ".join(random.Random(d).choices(("a b c d" if d % 2 else "v w x y").split(), k=30)) + f" Rare{d}") for d in range(60)]
    rows += [(100, None), (101, ""), (None, "a b"), (102, "never seen")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in hmm.score(docs, F.col("doc_id") < 50, states=3, vocabulary=6).collect()}
    train = [t.encode().lower().split() + [b""] for d, t in rows if d is not None and d < 50]
    counts = {}
    for t in train:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for d, text in rows:
        tokens = (text or "").encode().lower().split() + [b""]
        assert np.isclose(got[d].base_score, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
    held = [got[d] for d in range(50, 60)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(spark.createDataFrame([], DOCS), F.lit(True)).collect() == []


def test_hmm_learns_from_long_documents_and_counts_repeated_rows(spark):
    rng = random.Random(4)
    long = [" ".join(rng.choices("a b c d".split() if d % 2 else "v w x y".split(), k=3000)) for d in range(8)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(long)] + [(0, long[0])] * 2 + [(90, "a b c d a b"), (91, "v w x y v w"), (92, " \t\x0b ")], DOCS)
    got = hmm.score(docs, F.col("doc_id") < 50, states=2).collect()
    assert {r.train_tokens for r in got} == {10 * 3001} and len({r.score for r in got if r.doc_id == 0}) == 1 and len(got) == 13
    one = {r.doc_id: r for r in got}
    assert one[92].n_tokens == 1 and one[90].n_known == 7
    assert one[90].score > one[90].base_score + 1 and one[91].score > one[91].base_score + 1  # each topic has its state


def test_words_are_parted_as_bytes_are():
    texts = ["", None, " a  b\x0bc\x1fd\u00a0e\u3000 ", "ÉA\r\n", "\t"]
    flat, n = hmm.split(hmm.pa.array(texts))
    want = [hmm.tokens_of(t)[:-1] for t in texts]
    assert [w.encode() for w in flat.to_pylist()] == [w for t in want for w in t] and n.tolist() == [len(t) for t in want]


def test_frequent_tokens_by_histogram(spark):
    rows = [(f"t{k}".encode(), max(1, 400 // (k + 1))) for k in range(400)]
    counts = spark.createDataFrame(rows, "token binary, c long")
    for most in (1, 3, 50, 150, 400):
        got = hmm.frequent(counts, most)
        assert len(got) <= most and [r.c for r in got] == sorted((c for _, c in rows if c >= (got[-1].c if got else 1e9)), reverse=True)
        assert len(got) == 400 if most == 400 else sum(c >= max(x for _, x in rows if x < got[-1].c) for _, c in rows) > most


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for d in range(600):
        toxic = d % 4 == 0
        text = rng.choices(words, k=30) + (["awfulword"] if toxic else []) + (["women"] if toxic and d % 8 == 0 else [])
        rows.append((d, " ".join(text), 1))
        labels.append((d, int(toxic)))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "AWFULWORD!", 1), (1003, "women w1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(5, None), (9999, 1)], "doc_id long, toxic int"), F.col("doc_id") < 500)
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, ["doc_id", "score"], "s").collect()}
    assert all((got[d] >= 0.7) == (d % 4 == 0) for d in range(500, 600))
    assert got[1000] == got[1001] < 0.5 and got[1002] > 0.7 and got[1003] < 0.5
    blank = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, blank, [], "s").first().s == 0.5


def test_penalty_spares_neutral_mentions(spark):
    rng = random.Random(7)
    words, rows, labels = [f"w{k}" for k in range(300)], [], []
    for d in range(1200):  # one group is named in most toxic texts and in few others
        toxic = d % 3 == 0
        text = rng.choices(words, k=20) + (["vile"] if toxic and rng.random() < 0.7 else [])
        text += ["muslims"] if rng.random() < (0.7 if toxic else 0.02) else []
        rows.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    rows += [(5000 + k, " ".join(rng.choices(words, k=20) + ["muslims"])) for k in range(100)]
    rows += [(6000 + k, " ".join(rng.choices(words, k=20) + ["vile"])) for k in range(100)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + labels[:9], "doc_id long, toxic int")
    found = {}
    for penalty in (0.0, 30.0):
        model = toxicity.fit(docs, known, F.col("doc_id") < 1000, penalty=penalty)
        scores = {r.doc_id: r.s for r in toxicity.score(docs, model, ["doc_id"], "s").collect()}
        found[penalty] = [sum(scores[a + k] >= 0.5 for k in range(100)) for a in (5000, 6000)]
    assert found[0.0][0] > 90 and found[30.0][0] < 10 and min(found[0.0][1], found[30.0][1]) > 90, found


def test_texts_without_groups_make_pairs():
    for words in (set(), {"a"}, {"b", "c"}):
        one, other = toxicity.counterfactual(words)
        assert one != other and any(one < set(g) and other < set(g) for g in toxicity.IDENTITY_TERMS)
    assert toxicity.counterfactual({"women", "x"}) == ({"women"}, {"men"})


def test_swaps_pull_identity_terms_together():
    rows, swapped, y = [[0], [0], [1], [1]] * 20, [[1], [1], [0], [0]] * 20, np.array([1, 1, 0, 1] * 20, float)
    free, _ = toxicity.fit_weights(rows, [None] * 80, y, 2)
    bound, _ = toxicity.fit_weights(rows, swapped, y, 2, penalty=10)
    assert abs(bound[0] - bound[1]) < 0.2 * abs(free[0] - free[1])
