"""Spans of a token-labelling model that the caller brings: windows over tokens, argmax, BIO islands. Arrow batches, one model a worker."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.spans import bio_islands, drop_contained

#: Tokens (start and end in characters) of a text, and logits (tokens x labels) of a window of them.
Tokenise = Callable[[str], list[tuple[int, int]]]
Infer = Callable[[str, list[tuple[int, int]]], np.ndarray]


def label_map(path: str) -> dict[int, str]:
    """Labels by number from a JSON file; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {int(k): str(v) for k, v in json.load(f).items()}


def windows_of(length: int, longest: int = 511, overlap: int = 64) -> list[tuple[int, int]]:
    if longest <= overlap:
        raise ValueError("a window must be longer than the overlap")
    starts = range(0, max(length - overlap - 1, 0) + 1, longest - overlap) if length else []
    return [(a, min(a + longest, length)) for a in starts]


def model_spans(df: DataFrame, key: str, load: Callable[[], tuple[Tokenise, Infer] | None], labels: dict[int, str], text: str = "text", threshold: float = 0.70, longest: int = 511, overlap: int = 64) -> DataFrame:
    """(key, kind, start, end, score) of the spans a model finds; ``key`` is unique in ``df``.

    ``load`` runs once in a worker's task; if it gives None or fails, there are no spans and the rest of the
    work goes on. Blank texts ask nothing. Spans of overlapping windows that lie in others of their kind go.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = load()
        except Exception as error:  # a missing model or library is no failure of the job
            logging.getLogger(__name__).warning("no model: %s", error)
            model = None
        if model is None:
            return
        tokenise, infer = model
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["text"]):
                if not t or not t.strip():
                    continue
                tokens = tokenise(t)
                for number, (a, b) in enumerate(windows_of(len(tokens), longest, overlap)):
                    logits = np.asarray(infer(t, tokens[a:b]), np.float64)
                    best = logits.argmax(1)
                    prob = 1 / np.exp(logits - logits.max(1, keepdims=True)).sum(1)
                    out += [(k, number, i, s, e, labels.get(int(c), "O"), float(p)) for i, ((s, e), c, p) in enumerate(zip(tokens[a:b], best, prob))]
            yield pd.DataFrame(out, columns=[key, "window", "pos", "start", "end", "label", "prob"])

    rows = df.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, window int, pos int, start long, end long, label string, prob double")
    found = bio_islands(rows.withColumn("_at", F.struct(key, "window")), "_at", threshold)
    return drop_contained(found.select(F.col("_at")[key].alias(key), "kind", "start", "end", "score"), key)
