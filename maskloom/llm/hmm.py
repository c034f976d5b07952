"""A hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward pass.

Tokens are the words of the text with A-Z lowered (runs without ASCII white space) and one end.
The ``vocabulary`` most frequent training tokens are symbols of their own; every other token emits the
symbol of its class (by its last letters) and then itself by add-one counts within the class, in
which all unseen tokens are one more type. So the model is a distribution over all texts, its state
size is bounded, and what it counts grows with the corpus.

Training: counts of all training tokens; then rounds of a mixture over all training documents, which
begins with shares of the states drawn from a hash of each document, so that equal documents start alike;
then Baum-Welch passes over all of them, ``passes`` at most, fewer once one gains less than ``gain``
log10 probability a token. A round or a pass has each task return expected counts, which are added up
by blocks of symbols in two shuffles. Nothing is sampled. Encoded documents are written once and reread.

Cases: null and empty texts are one end token; rows with null doc_id count like any other (their
key is the empty string); repeated rows count each and are scored alike; without training rows the base
and the model give every token probability 1; very long texts are learnt from and scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import partitions, stash
from maskloom.llm.near_dedup import mix

END = b""
CLASSES = 1024
TAIL = 3


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words as bytes, then the end."""
    return (text or "").encode("utf-8", "replace").lower().split() + [END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: empty), and how many each text has."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = pc.ascii_split_whitespace(clean)
    flat, n = words.flatten(), np.diff(words.offsets.to_numpy())
    blank = pc.equal(clean, "").to_numpy(zero_copy_only=False)
    if blank.any():
        flat = flat.filter(pc.not_equal(flat, ""))
        n = np.where(blank, 0, n)
    return flat, n


def slices(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-TAIL:]) % CLASSES


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @property
    def states(self) -> int:
        return len(self.start)


def _order(lengths: np.ndarray, tokens: int) -> Iterator[np.ndarray]:
    """Documents by falling length, in groups of at most about ``tokens`` symbols."""
    order = np.argsort(-lengths, kind="stable")
    group = np.cumsum(lengths[order]) // tokens
    for g in np.unique(group):
        yield order[group == g]


def _grid(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time step of documents of falling length, and how many are alive at each step."""
    steps = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")
    grid = np.zeros((steps, len(lengths)), np.int32)
    for t in range(steps):
        n = alive[t]
        grid[t, :n] = symbols[starts[:n] + t]
    return grid, alive


def forward(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of every symbol sequence (none empty), by the scaled forward recursion."""
    lengths = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs))
    flat, first = np.concatenate(docs), np.cumsum(lengths) - lengths
    for order in _order(lengths, 4_000_000):
        n_of, at = lengths[order], first[order]
        alive = np.searchsorted(-n_of, -np.arange(int(n_of[0])), "left")
        alpha, log = model.start[None, :].repeat(len(order), 0), np.zeros(len(order))
        for t, n in enumerate(alive.tolist()):
            alpha = (alpha[:n] @ model.move if t else alpha) * model.emit[flat[at[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            log[:n] += np.log10(scale)
        out[order] = log
    return out


def expected(model: Model, docs: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add the expected starts, moves and emissions of the sequences to ``counts`` (forward-backward); their log10 likelihood."""
    likely = 0.0
    start, move, emit = counts
    lengths = np.array([len(d) for d in docs], np.int64)
    flat, first = np.concatenate(docs), np.cumsum(lengths) - lengths
    k = model.states
    for order in _order(lengths, 250_000):
        grid, alive = _grid(flat, first[order], lengths[order])
        steps, width = grid.shape
        b = model.emit[grid]
        alpha = np.zeros((steps, width, k))
        scale = np.ones((steps, width))
        now = model.start[None, :] * b[0]
        for t in range(steps):
            n = alive[t]
            if t:
                now = (alpha[t - 1, :n] @ model.move) * b[t, :n]
            scale[t, :n] = now.sum(1)
            alpha[t, :n] = now / scale[t, :n, None]
        likely += float(np.log10(scale).sum())
        gamma = alpha
        beta = np.ones((width, k))
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            if t + 1 < steps and (m := alive[t + 1]):
                ahead = b[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
                move += model.move * (alpha[t, :m].T @ ahead)
                beta[:m] = ahead @ model.move.T
            gamma_t = alpha[t, :n] * beta[:n]
            if t + 1 < steps:  # alpha[t] isn't needed further on
                gamma[t, :n] = gamma_t
        start += gamma[0].sum(0)
        live = (np.arange(width)[None, :] < alive[:, None]).ravel()
        symbols, weights = grid.ravel()[live], gamma.reshape(-1, k)[live]
        for s in range(k):
            emit[:, s] += np.bincount(symbols, weights[:, s], len(emit))
    return likely


def maximise(counts: tuple[np.ndarray, np.ndarray, np.ndarray], unigram: np.ndarray, weight: float = 500.0) -> Model:
    """Smoothed parameters: emissions are drawn to the overall frequencies, moves and starts to even ones."""
    start, move, emit = counts
    start = (start + 1) / (start + 1).sum()
    move = (move + 1) / (move + 1).sum(1, keepdims=True)
    emit = (emit + weight * unigram[:, None]) / (emit.sum(0) + weight)[None, :]
    return Model(start, move, emit)


def drawn_shares(docs: list[np.ndarray], states: int) -> np.ndarray:
    """Uneven shares of the states for each document, by a hash of its symbols."""
    seed = np.array([zlib.crc32(d.tobytes()) for d in docs], np.uint64)
    drawn = mix(seed[:, None] * np.uint64(2 * states + 1) + np.arange(1, states + 1, dtype=np.uint64)[None, :])
    share = (((drawn >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) ** 3.3
    return share / share.sum(1, keepdims=True)


def mixed(model: Model | None, docs: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add to ``counts`` what a mixture of unigram models expects, each state a part; without ``model``, by drawn shares."""
    start, _, emit = counts
    states, lengths = len(start), np.array([len(d) for d in docs])
    flat = np.concatenate(docs)
    if model is None:
        share = drawn_shares(docs, states)
    else:
        fit = np.add.reduceat(np.log(model.emit + 1e-12)[flat], np.cumsum(lengths) - lengths, axis=0) + np.log(model.start)
        share = np.exp((fit - fit.max(1, keepdims=True)) / np.sqrt(lengths)[:, None])  # softened, so that parts can still move
        share /= share.sum(1, keepdims=True)
    start += share.sum(0)
    for s in range(states):
        emit[:, s] += np.bincount(flat, np.repeat(np.ascontiguousarray(share[:, s]), lengths), len(emit))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``docs`` (text); counted in each slice first, merged in tables of bounded size, then by Spark."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch):
                words, _ = split(part["text"])
                found = words.value_counts()
                tokens = pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
                held.append(pa.table({"token": tokens, "c": pa.concat_arrays([found.field("counts"), pa.array([len(part)], pa.int64())])}))
                if sum(t.num_rows for t in held) > 1_000_000:
                    held = [merged(held)]
                    if held[0].num_rows > 500_000:
                        yield from held.pop().to_batches(max_chunksize=100_000)
        if held:
            yield from merged(held).to_batches(max_chunksize=100_000)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list:
    """Rows of the tokens that occur at least as often as a cut-off under which they are ``most`` at most, most frequent first.

    The cut-off comes from histograms of the counts, so that no task sends tokens that aren't chosen.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    bins = {r[0]: r[1] for r in counts.groupBy(level.alias("level")).count().collect()}  # 8 for each power of 2
    held, edge = 0, None
    for k in sorted(bins, reverse=True):
        if held + bins[k] > most:
            edge = k
            break
        held += bins[k]
    cut = 0
    if edge is not None:  # the counts of one level, a range of a tenth
        cut = None
        for c, n in sorted(((r[0], r[1]) for r in counts.filter(level == edge).groupBy("c").count().collect()), reverse=True):
            if held + n > most:
                cut = c + 1
                break
            held += n
    return sorted(counts.filter(F.col("c") >= F.lit(cut or 0)).collect(), key=lambda r: (-r.c, r.token))


ENCODED = "doc_id long, train boolean, row long, ids binary, n_tokens long, rare array<struct<token:binary,n:int>>"


def encode(docs: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """Documents as uint16 symbols, with the counts of their tokens outside the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(symbols)  # at most ``vocabulary`` entries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, first_class, at = sent.value.get, len(sent.value), TaskContext.get().partitionId() << 40
        end = get(END, first_class + class_of(END))
        for batch in batches:
            for part in slices(batch):
                words, n = split(part["text"])
                numbered = words.cast(pa.binary()).dictionary_encode()
                tokens, code = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
                symbol = np.array([get(t, -1) for t in tokens.to_pylist()] + [0], np.int64)[:-1]
                odd = np.flatnonzero(symbol < 0)
                symbol[odd] = [first_class + class_of(t) for t in tokens.take(pa.array(odd)).to_pylist()]
                ids = np.insert(symbol[code], np.cumsum(n), end).astype("<u2")
                ends = np.cumsum(n + 1)
                is_odd = np.zeros(len(tokens), bool)
                is_odd[odd] = True
                doc = np.repeat(np.arange(len(part)), n)
                pair, count = np.unique((doc * max(1, len(tokens)) + code)[is_odd[code]] if len(code) else code, return_counts=True)
                of, which = pair // max(1, len(tokens)), pair % max(1, len(tokens))
                if end >= first_class:  # only where the end itself isn't frequent enough
                    of, which = np.concatenate([of, np.arange(len(part))]), np.concatenate([which, np.full(len(part), len(tokens))])
                    count, tokens = np.concatenate([count, np.ones(len(part), np.int64)]), pa.concat_arrays([tokens, pa.array([END], pa.binary())])
                    order = np.argsort(of, kind="stable")
                    of, which, count = of[order], which[order], count[order]
                rare = pa.StructArray.from_arrays([tokens.take(pa.array(which)), pa.array(count.astype(np.int32))], ["token", "n"])
                per = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
                places = pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], part["train"], pa.array(np.arange(at, at + len(part))),
                    pa.Array.from_buffers(pa.binary(), len(part), [None, places, pa.py_buffer(ids.tobytes())]), pa.array(n.astype(np.int64) + 1),
                    pa.ListArray.from_arrays(per, rare),
                ], ["doc_id", "train", "row", "ids", "n_tokens", "rare"])
                at += len(part)

    return docs.select("doc_id", "train", "text").mapInArrow(run, ENCODED)


def _sum_blocks(parts: DataFrame, by: list[str]) -> DataFrame:
    """Add up payloads (float32 arrays) of equal keys as a stream."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = (row.part, row.salt)
                if now != key:
                    if key is not None:
                        out.append((*key, total.tobytes()))
                    key, total = now, np.zeros(len(row.payload) // 8)
                total += np.frombuffer(row.payload, np.float64)
            yield pd.DataFrame(out, columns=["part", "salt", "payload"])
        if key is not None:
            yield pd.DataFrame([(*key, total.tobytes())], columns=["part", "salt", "payload"])

    dealt = parts.repartition(partitions(parts.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInPandas(run, "part int, salt int, payload binary")


def _counted(train: DataFrame, model: Model | None, step, states: int, size: int, block: int = 2048) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float] | None:
    """What ``step`` adds to the counts over all rows of ``train`` (ids), added up by symbol blocks, and its likelihood."""
    k = states
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        counts, likely = (np.zeros(k), np.zeros((k, k)), np.zeros((size, k))), 0.0
        docs, held = [], 0
        for batch in batches:
            for ids in batch["ids"]:
                docs.append(np.frombuffer(ids, "<u2"))
                held += len(docs[-1])
                if held > 2_000_000:
                    likely += step(sent.value, docs, counts) or 0.0
                    docs, held = [], 0
        if docs:
            likely += step(sent.value, docs, counts) or 0.0
        parts = [np.concatenate([[likely], counts[0], counts[1].ravel()])] + [counts[2][a : a + block].ravel() for a in range(0, size, block)]
        salt = TaskContext.get().partitionId() % 16
        yield pd.DataFrame({"part": range(-1, len(parts) - 1), "salt": salt, "payload": [p.tobytes() for p in parts]})

    parts = train.select("ids").mapInPandas(run, "part int, salt int, payload binary")
    summed = _sum_blocks(_sum_blocks(parts, ["part", "salt"]).withColumn("salt", F.lit(0)), ["part", "salt"])
    got = {r.part: np.frombuffer(r.payload, np.float64) for r in summed.collect()}  # the model's size
    if not got:
        return None
    emit = np.concatenate([got[p] for p in sorted(got) if p >= 0]).reshape(size, k)
    return (got[-1][1 : k + 1], got[-1][k + 1 :].reshape(k, k), emit), float(got[-1][0])


def train_model(train: DataFrame, unigram: np.ndarray, tokens: int, states: int, rounds: int, passes: int, gain: float) -> Model:
    """The model after the mixture's rounds and the Baum-Welch passes over all rows of ``train`` (ids)."""
    size, sticky = len(unigram), np.eye(states) * 9 + 1.0
    model = maximise((np.zeros(states), sticky, np.zeros((size, states))), unigram)
    for number in range(rounds + 1):
        counted = _counted(train, model if number else None, mixed, states, size)
        if counted is None:
            return model
        model = maximise((counted[0][0], sticky * tokens / 10 / states, counted[0][2]), unigram, 50.0 if number < rounds else 500.0)
    before = None
    for _ in range(passes):
        counts, likely = _counted(train, model, expected, states, size)
        model = maximise(counts, unigram)
        if before is not None and likely - before < gain * tokens:
            break
        before = likely
    return model


def score(docs: DataFrame, is_train: Column, states: int = 8, vocabulary: int = 32_768, rounds: int = 2, passes: int = 2, gain: float = 0.001) -> DataFrame:
    """Base and model log10 probabilities of all rows of ``docs`` (doc_id, text), learnt from those with ``is_train``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_train, F.lit(False)).alias("train"), "text")
    counts = stash(count_tokens(docs.filter("train")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, vocabulary)
    symbols = {bytes(r.token): i for i, r in enumerate(top)}
    rank_c = np.array([r.c for r in top], float)
    names = counts.withColumn("class", (F.crc32(F.substring("token", -TAIL, TAIL)) % CLASSES).cast("int"))
    classes = names.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # at most CLASSES
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_n[r["class"]], class_v[r["class"]] = r.n, r.v
    for token, i in symbols.items():
        class_n[class_of(token)] -= rank_c[i]
        class_v[class_of(token)] -= 1
    unigram = np.concatenate([rank_c, class_n + 1])
    unigram /= unigram.sum()

    coded = stash(encode(docs, symbols), "encoded")
    train = coded.filter("train")
    model = train_model(train, unigram, max(1, int(total.n)), states, rounds, passes, gain)

    # tokens outside the vocabulary: their counts come by a join, as there is no bound on them
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    known = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known")
    )
    base_log = np.concatenate([np.log10(rank_c + 1), np.zeros(CLASSES)]) - np.log10(total.n + total.v + 1)
    in_class = np.concatenate([np.zeros(len(symbols)), -np.log10(class_n + class_v + 1)])
    sent = docs.sparkSession.sparkContext.broadcast((model, base_log, in_class, len(symbols), total.n == 0))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, base_log, in_class, size, blank = sent.value
        for batch in batches:
            if not len(batch):
                continue
            ids = [np.frombuffer(b, "<u2") for b in batch["ids"]]
            zero = np.zeros(len(ids))
            likely = zero if blank else forward(model, ids)
            yield pd.DataFrame({
                "row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "train": batch["train"], "n_tokens": batch["n_tokens"],
                "common": [int((d < size).sum()) for d in ids], "base": [base_log[d].sum() for d in ids],
                "model": likely + (zero if blank else np.array([in_class[d].sum() for d in ids])),
            })

    scored = coded.select("row", "doc_id", "train", "n_tokens", "ids").mapInPandas(run, "row long, doc_id long, train boolean, n_tokens long, common long, base double, model double")
    both = scored.join(known, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    return both.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare_log")).alias("base_score"), (F.col("model") + F.col("rare_log")).alias("score"),
    )
