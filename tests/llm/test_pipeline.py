import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from maskloom.llm import queries, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, cut string, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    rng = random.Random(3)
    words, rows, labels = [f"w{k}" for k in range(400)], [], []
    for d in range(240):
        toxic = d % 6 == 0
        text = " ".join(rng.choices(words, k=40) + ["vileword"] * toxic) + ("\nshared line on every site" if d % 2 else "")
        rows.append((d, text, "en", f"s{d % 7}"))
        labels.append((d, int(toxic)))
    rows += [(1000, rows[1][1], "en", "s1"), (1001, rows[7][1] + " w1", "en", "s2"), (1002, None, None, None), (1003, "", "en", "s1"), (None, rows[8][1], "en", "s3"), (1004, "w5 " * 9000, "en", "s4"), (5, rows[5][1], "en", "s5")]
    spark.createDataFrame([(*r, len(r[1] or ""), "x", 7, "y", 0.5) for r in rows], SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels + [(3, None), (None, 1), (7777, 1)], "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
    return f"file://{at}"


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, rows = docs, {}
    for name, stage in stages.STAGES:
        kept = stage(spark, kept, folder)
        if name != "packing":
            assert kept.columns == docs.columns
        rows[name] = kept.collect()
    ids = {name: [r.doc_id for r in some] for name, some in rows.items()}
    assert not any(d is not None and d < 240 and d % 6 == 0 for d in ids["toxicity"]) and {1, 2, 1002, 1003, 1004, None} <= set(ids["toxicity"])
    assert len(ids["toxicity"]) == 200 + 7
    lines = [r for r in rows["line_dedup"] if r.text and "shared line" in r.text]
    assert sorted(r.doc_id for r in lines) == [1, 1001] and all(r.text is None or r.n_chars == len(r.text) for r in rows["line_dedup"])
    assert sorted(ids["near_dedup"], key=lambda d: d or 0) == sorted([d for d in range(240) if d % 6] + [1002, 1003, 1004])  # copies and repeated rows go
    pieces = [(r.doc_id, r.piece) for r in rows["packing"]]
    assert len(pieces) == len(set(pieces)) and {d for d, _ in pieces} == set(ids["near_dedup"])
    out = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows["packing"])


def test_stages_of_an_empty_table(spark, folder):
    kept = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in stages.STAGES:
        kept = stage(spark, kept, folder)
        assert kept.collect() == []


def test_queries_of_documents(spark, folder):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op5_byte_bpe", "op7_token_files", "op10_toxicity"):
        assert queries.QUERIES[name](spark, folder).count() == n
    tokens = queries.op7_token_files(spark, folder).orderBy("start").collect()
    assert [r.start for r in tokens] == [sum(x.n_tokens for x in tokens[:k]) for k in range(n)]
    held = queries.op10_toxicity(spark, folder).filter(F.col("held_out") & F.col("doc_id").between(0, 239)).collect()
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in held)
