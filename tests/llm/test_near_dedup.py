import random
from collections import Counter

import numpy as np

from maskloom.llm import near_dedup
from maskloom.llm.components import Forest, components


def brute(texts):
    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = {d: bag(t) for d, t in texts.items()}
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = sum(bags[a].values()) + sum(bags[b].values())
            both = sum((bags[a] & bags[b]).values())
            if n and both / (n - both) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_large_group_of_near_copies_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    texts = {}
    for d in range(250):  # copies at many distances, of which few are close to the smallest
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            words[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        texts[d] = " ".join(words)
    texts |= {1000: "one two", 1001: "one two", 1002: "", 1003: None, 1004: "ONE two", 1005: "again " * 300, 1006: "again " * 310, 1007: "again " * 900}
    rows = [(d, t, "x") for d, t in texts.items()] + [(None, "one two", "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    want = brute(texts)
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(kept == (want[d] == d) for d, (_, kept) in got.items())
    few = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, most=40, words=9_000).collect() if r.doc_id is not None}
    assert few == want  # blocks of other sizes find the same classes
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in texts if want[d] == d)
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "x"), (None, "a b c", "x"), (None, "a b c", "x"), (None, "other", "x"), (None, "other", "x"), (None, None, "x"), (None, None, "x"), (7, "", "x")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, "other"), (1, "a b c"), (7, "")]


def test_forest_joins_as_all_pairs_do():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") if rng.random() < 0.9 else "c" for _ in range(rng.randrange(9, 14))) for _ in range(120)]
    sets = [near_dedup.multiset(t) for t in texts]
    want = brute(dict(enumerate(texts)))
    for blocks in (np.zeros(120, int), np.arange(120) % 2):
        forest = Forest()
        edges = near_dedup.forest_of(np.arange(120), np.arange(120), blocks, sets)
        assert len(edges) < 120 and all(near_dedup.overlap(sets[a], sets[b]) >= 0.8 for a, b in edges)
        for a, b in edges if not blocks.any() else edges + near_dedup.forest_of(np.arange(0, 120, 2), np.arange(0, 120, 2), np.zeros(60, int), sets[::2]) + near_dedup.forest_of(np.arange(1, 120, 2), np.arange(1, 120, 2), np.zeros(60, int), sets[1::2]):
            forest.join(a, b)
        assert {d: forest.find(d) for d in range(120)} == want


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    items = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    s = near_dedup.signatures([(items, a), (items, b)], 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
