"""Toxicity: a counterfactual-regularised logistic classifier on words and word beginnings.

Fitting uses about ``sample`` labelled rows at most, those of smallest key hash (a documented bound);
features are counted over these rows on the executors, the weights are fitted on the driver on
sparse rows of at most ``features`` numbers each. For every labelled text that names a group,
each identity term is swapped for another of its list; a text that names none makes its pair by
taking in one term of a list, or another. The squared change of the logit between the two of a pair is
penalised, so that which group is named doesn't move the score.

Cases: null and empty texts get the score of no evidence; labels that are null or without a
document are ignored, of repeated labels the largest counts; without any labels of both
classes the score is the base rate for all (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import stash

_WORD = re.compile(r"[^\W_]+")
PREFIXES = range(3, 8)

# Identity terms, by lists within which one may stand for another.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs"],
    ["frauen", "männer", "muslime", "christen", "juden"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos"],
]
SWAP = {term: group[(k + 1) % len(group)] for group in IDENTITY_TERMS for k, term in enumerate(group)}


def counterfactual(words: set[str]) -> tuple[set[str], set[str]]:
    """What two wordings that differ in the groups they name add to the other words of a text."""
    named = {w for w in words if w in SWAP}
    if named:
        return named, {SWAP[w] for w in named}
    drawn = zlib.crc32(" ".join(sorted(words)).encode("utf-8", "replace"))
    group = IDENTITY_TERMS[drawn % len(IDENTITY_TERMS)]
    one = group[drawn // 64 % len(group)]
    return {one}, {SWAP[one]}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Each word, and its beginnings of 3 to 7 letters marked by a star."""
    out = set(words)
    for word in words:
        for n in PREFIXES:
            if len(word) <= n:
                break
            out.add(word[:n] + "*")
    return out


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def numbers(self, text: str) -> list[int]:
        """Sorted feature numbers of a text."""
        get = self.index.get
        return sorted({i for f in features_of(words_of(text)) if (i := get(f)) is not None})

    def score(self, text: str) -> float:
        weights, total = self.weights, self.bias
        for i in self.numbers(text):
            total += weights[i]
        return 1 / (1 + math.exp(-min(max(total, -500), 500)))


def fit_weights(rows: list[list[int]], swapped: list, labels: np.ndarray, n: int, penalty: float = 1.0, ridge: float = 1e-5, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge and the mean squared logit change of pairs, by accelerated gradient.

    ``swapped`` has for each row its counterpart, or a pair of rows of which neither need be it, or None.
    """
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return np.zeros(n), math.log(rate / (1 - rate))

    def flat(some):
        lengths = np.array([len(r) for r in some], np.int64)
        return np.repeat(np.arange(len(some)), lengths), np.array([i for r in some for i in r], np.int64)

    at, idx = flat(rows)
    pairs = [(r, s) if isinstance(s, list) else s for r, s in zip(rows, swapped) if s is not None] if penalty else []
    d_at, d_idx = flat([r + s for r, s in pairs])
    d_sign = np.concatenate([np.r_[np.ones(len(r)), -np.ones(len(s))] for r, s in pairs]) if pairs else np.zeros(0)
    m, w, b = len(labels), np.zeros(n), math.log(labels.mean() / (1 - labels.mean()))

    def curvature(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        out = 0.25 * (np.bincount(at, w[idx], m) + b) / m
        g = np.bincount(idx, out[at], n) + ridge * w
        if pairs:
            change = np.bincount(d_at, w[d_idx] * d_sign, len(pairs)) / len(pairs)
            g += penalty * np.bincount(d_idx, change[d_at] * d_sign, n)
        return g, out.sum()

    pw, pb, bound = np.random.default_rng(3).standard_normal(n), 1.0, 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        pw, pb = curvature(pw, pb)
        bound = math.sqrt(float(pw @ pw) + pb * pb)
        pw, pb = pw / bound, pb / bound
    vw, vb, step = w.copy(), b, 0.9 / bound
    for k in range(steps):
        logits = np.bincount(at, vw[idx], m) + vb
        off = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels) / m
        gw = np.bincount(idx, off[at], n) + ridge * vw
        if pairs:
            change = np.bincount(d_at, vw[d_idx] * d_sign, len(pairs))
            gw += penalty * np.bincount(d_idx, (change[d_at] * d_sign) / len(pairs), n)
        nw, nb = vw - step * gw, vb - step * off.sum()
        push = k / (k + 3)
        vw, vb, w, b = nw + push * (nw - w), nb + push * (nb - b), nw, nb
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = 16_000, features: int = 4096, least_docs: int = 5, least_chi2: float = 25.0, penalty: float = 1.0) -> Model:
    """Fit on about ``sample`` at most of the rows of ``labels`` (doc_id, toxic) for which the column ``train`` of doc_id holds."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.filter(train)
    if (found := chosen.count()) > sample:  # by a threshold of a hash, so no task sends rows that aren't chosen
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / found))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows at most

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, all_of = Counter(), Counter()
        docs_seen = np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                found = features_of(words_of(text))
                all_of.update(found)
                docs_seen += (label, 1)
                if label:
                    toxic.update(found)
        names = list(all_of)
        yield pd.DataFrame({"feature": names + [""], "toxic": [toxic[f] for f in names] + [docs_seen[0]], "docs": [all_of[f] for f in names] + [docs_seen[1]]})

    counted = rows.select("text", "toxic").mapInPandas(count, "feature string, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("docs").alias("n"))
    counted = stash(counted, "features")
    totals = counted.filter("feature = ''").first()
    all_t, all_n = (totals.t, totals.n) if totals and totals.n else (0, 1)
    expected = F.col("n") * (all_t / all_n)
    spread = expected * (1 - all_t / all_n) * (1 - F.col("n") / all_n)
    best = (
        counted.filter((F.col("feature") != "") & (F.col("n") >= least_docs))
        .withColumn("chi2", F.when(spread > 0, (F.col("t") - expected) ** 2 / spread).otherwise(0.0))
        .filter(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "feature").limit(features).select("feature")
    )
    index = {r.feature: i for i, r in enumerate(best.collect())}
    model = Model(index, np.zeros(len(index)), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def number(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = sent.value.index.get

        def numbers(words: set[str]) -> list[int]:
            return sorted({i for f in features_of(words) if (i := get(f)) is not None})

        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                one, other = counterfactual(words)
                rest = words - one
                out.append([numbers(words), numbers(rest | one), numbers(rest | other)])
            yield pd.DataFrame({"toxic": batch["toxic"], "own": [o[0] for o in out], "left": [o[1] for o in out], "right": [o[2] for o in out]})

    train_rows = rows.select("text", "toxic").mapInPandas(number, "toxic int, own array<int>, left array<int>, right array<int>").collect()  # about ``sample``
    train_rows.sort(key=lambda r: (r.toxic, r.own, r.left, r.right))
    y = np.array([r.toxic for r in train_rows], float)
    pairs = [None if r.left == r.right else (r.left, r.right) for r in train_rows]  # equal ones penalise nothing
    model.weights, model.bias = fit_weights([r.own for r in train_rows], pairs, y, len(index), penalty)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], column: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the score of ``text`` (null: empty)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([sent.value.score(t or "") for t in some], dtype="float64")

    return docs.select(*keep, of(F.col("text")).alias(column))
