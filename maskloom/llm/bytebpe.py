"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation runs no pattern. Every code point gets a symbol from a class table; a small
automaton over the symbols reads the text; since composing transition functions is associative,
the text is cut into equal rows, the functions of all rows are composed column by column with
numpy, the rows' entry states follow by a scan over the rows, and a second column pass yields
each position's state. Token boundaries are read off states and neighbouring symbols.

Cases: null text is empty; an empty text has no ids; very long texts and very long runs are
handled whole (merging uses a heap, so it stays n log n); repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols. Letters that can follow an apostrophe in a contraction have their own.
LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, CUT = range(7)
ENDS1, LET_R, LET_V, LET_L, LET_E = range(7, 12)  # s t m d; r; v; l; e
SYMBOLS = 12

# States after a symbol.
START, IN_LETTERS, IN_NUMBERS, AFTER_SPACE, AFTER_WHITE, IN_OTHER, QUOTE, Q_R, Q_V, Q_L, DONE = range(11)
STATES = 11

# The code points with the property White_Space.
WHITE_POINTS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_POINTS] = WHITE
    table[32] = SPACE
    table[39] = APOSTROPHE
    for letter, symbol in zip("stmdrvle", [ENDS1] * 4 + [LET_R, LET_V, LET_L, LET_E]):
        table[ord(letter)] = symbol
    return table


def _transitions() -> np.ndarray:
    go = np.zeros((SYMBOLS, STATES), np.uint8)
    for symbol in range(SYMBOLS):
        letter = symbol == LETTER or symbol > CUT
        for state in range(STATES):
            if symbol == CUT:
                to = START
            elif letter:
                to = IN_LETTERS
                if state == QUOTE:
                    to = {ENDS1: DONE, LET_R: Q_R, LET_V: Q_V, LET_L: Q_L}.get(symbol, IN_LETTERS)
                elif (state, symbol) in ((Q_R, LET_E), (Q_V, LET_E), (Q_L, LET_L)):
                    to = DONE
            elif symbol == NUMBER:
                to = IN_NUMBERS
            elif symbol == SPACE:
                to = AFTER_SPACE
            elif symbol == WHITE:
                to = AFTER_WHITE
            elif symbol == APOSTROPHE:
                # an apostrophe begins a token unless it continues a run or takes the space before it
                to = IN_OTHER if state in (IN_OTHER, QUOTE, AFTER_SPACE) else QUOTE
            else:
                to = IN_OTHER
            go[symbol, state] = to
    return go


GO = _transitions()
_tables: dict[str, np.ndarray] = {}


def symbols_of(points: np.ndarray) -> np.ndarray:
    if "symbols" not in _tables:
        _tables["symbols"] = _symbol_table()
    return _tables["symbols"][points]


def scan_states(symbols: np.ndarray, width: int = 128) -> np.ndarray:
    """The automaton's state after every symbol, from START, by a blocked scan of transition functions."""
    n = len(symbols)
    rows = -(-n // width)
    grid = np.full(rows * width, CUT, np.uint8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = GO.ravel()
    base = columns.astype(np.int16) * STATES
    reach = np.tile(np.arange(STATES, dtype=np.int16), (rows, 1))  # the row's function so far
    for k in range(width):
        reach = flat[base[k][:, None] + reach].astype(np.int16)
        if k == 7:  # most functions are constant by now; only rows whose function is not go on in full
            break
    loose = np.flatnonzero((reach != reach[:, :1]).any(1))
    if k < width - 1:
        lead = reach[:, 0].copy()
        part = reach[loose]
        for j in range(k + 1, width):
            lead = flat[base[j] + lead].astype(np.int16)
            if len(loose):
                part = flat[base[j][loose][:, None] + part].astype(np.int16)
        reach = np.repeat(lead[:, None], STATES, 1)
        reach[loose] = part
    entry = np.empty(rows, np.int16)
    entry[:1] = START
    constant = (reach == reach[:, :1]).all(1)
    entry[1:] = reach[:-1, 0]
    for row in np.flatnonzero(~constant[:-1]) if rows else ():
        entry[row + 1] = reach[row, entry[row]]
    out = np.empty((width, rows), np.uint8)
    state = entry
    for k in range(width):
        state = flat[base[k] + state].astype(np.int16)
        out[k] = state
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Where tokens begin: true at the first code point of every token. CUT separates texts."""
    n = len(symbols)
    states = scan_states(symbols)
    before = np.empty(n, np.uint8)
    before[:1] = START
    before[1:] = states[:-1]
    after = np.full(n, CUT, np.uint8)
    after[:-1] = symbols[1:]
    next_state = np.full(n, START, np.uint8)
    next_state[:-1] = states[1:]
    letter = (symbols == LETTER) | (symbols > CUT)
    white = (symbols == SPACE) | (symbols == WHITE)
    white_before = (before == AFTER_SPACE) | (before == AFTER_WHITE)
    # a letter goes on in a run, takes one space before it, or lies inside a contraction
    inside = (states == DONE) | (((states == Q_R) | (states == Q_V) | (states == Q_L)) & (next_state == DONE))
    failed = ((before == Q_R) | (before == Q_V) | (before == Q_L)) & (states != DONE)
    starts = np.ones(n, bool)
    starts &= ~(letter & ((before == IN_LETTERS) | failed | (before == AFTER_SPACE) | inside))
    starts &= ~((symbols == NUMBER) & ((before == IN_NUMBERS) | (before == AFTER_SPACE)))
    other = (symbols == OTHER) | (symbols == APOSTROPHE)
    starts &= ~(other & ((before == IN_OTHER) | (before == QUOTE) | (before == AFTER_SPACE)))
    # of a run of white space before other text, the last one stands apart; at the end of a text it does not
    ends_run = ~((after == SPACE) | (after == WHITE) | (after == CUT))
    starts &= ~(white & white_before & ~ends_run)
    return starts


class ByteBpe:
    """Encoder and decoder of one rank table."""

    ENTRIES = 300_000
    LONGEST = 100

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        names = {i: b for b, i in ranks.items()}
        self.length = np.array([len(names.get(i, b"")) for i in range(max(names, default=-1) + 1)], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join([names[i] for i in sorted(names)]), np.uint8)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if raw in ranks:
            return (ranks[raw],)
        if len(raw) <= 48:
            parts = [raw[i : i + 1] for i in range(len(raw))]
            pair = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            while pair:
                low = min(pair)
                if low == 1 << 60:
                    break
                i = pair.index(low)
                parts[i] += parts.pop(i + 1)
                del pair[i]
                if i < len(pair):
                    pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
                if i:
                    pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            return tuple(ranks[p] for p in parts)
        n = len(raw)
        end = list(range(1, n + 1))  # of the part that begins here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(raw[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of every text, in order."""
        for group in _groups(texts):
            joined = "\x00".join(group) + "\x00"
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.array([len(t) + 1 for t in group])
            cuts = np.cumsum(lengths) - 1
            symbols = symbols_of(points)
            symbols[cuts] = CUT
            starts = np.flatnonzero(boundaries(points, symbols))
            per_text = np.searchsorted(starts, cuts, "right").tolist()
            places = starts.tolist()
            pieces = [joined[a:b] for a, b in zip(places, places[1:])]  # the last start is the last cut
            first = 0
            known = self.known
            for last in per_text:
                mine = pieces[first : last - 1]  # without the cut itself
                first = last
                try:
                    ids = [known[p] for p in mine]
                except KeyError:
                    if len(known) > self.ENTRIES:
                        known.clear()
                    ids = [known[p] if p in known else self._learn(p) for p in mine]
                yield [i for some in ids for i in some]

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode("utf-8", "replace"))
        if len(piece) <= self.LONGEST:
            self.known[piece] = ids
        return ids

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset at which each id begins in the decoded text, and where the last one ends."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[np.array(ids, np.int64)], out=out[1:])
        return out

    def decode(self, ids: list[int], offsets: np.ndarray | None = None, start: int = 0, stop: int | None = None) -> bytes:
        """Bytes of the text from ``start`` to ``stop``: only the ids there are looked at, each put at its offset."""
        at = self.offsets(ids) if offsets is None else offsets
        stop = int(at[-1]) if stop is None else min(stop, int(at[-1]))
        if start >= stop:
            return b""
        a, b = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
        some = np.array(ids[a:b], np.int64)
        n = self.length[some]
        place = np.repeat(self.first[some] - at[a:b], n) + np.arange(at[a], at[b])
        return self.flat[place].tobytes()[start - int(at[a]) : stop - int(at[a])]


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in groups of about ``chars`` characters; a longer text is a group of its own."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > chars:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_loaded: dict[bytes, ByteBpe] = {}


def byte_bpe(data: bytes) -> ByteBpe:
    """One coder per Python worker, kept over tasks."""
    key = hashlib.md5(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(parse_ranks(data))
    return _loaded[key]


def encode(docs: DataFrame, ranks: str, summarise=None, schema: str = "doc_id long, ids array<int>, offsets array<long>") -> DataFrame:
    """Ids and byte offsets of every document (doc_id, text); ``ranks`` is the path of a rank file.

    ``summarise(coder, doc_id, text, ids)`` may return another row per document, of ``schema``.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in schema.split(", ")]
    row = summarise or (lambda coder, doc, text, ids: (doc, ids, coder.offsets(ids)[:-1].tolist()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_bpe(data.value)
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 512):
                some = texts[at : at + 512]
                rows = [row(coder, d, t, ids) for d, t, ids in zip(batch["doc_id"].iloc[at : at + 512], some, coder.encode(some))]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The bytes of ``ids`` of every row of ``encoded`` (doc_id, ids); null ids stay null."""
    spark = encoded.sparkSession
    with open(ranks, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_bpe(data.value)
        for batch in batches:
            out = [None if ids is None else coder.decode([int(i) for i in ids]) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "decoded": out})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")


def digest_row(coder: ByteBpe, doc, text: str, ids: list[int]) -> tuple:
    """Count of ids, their digest, and the digest of what they decode to by their offsets."""
    written = " ".join(map(str, ids)).encode()
    return doc, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(coder.decode(ids, coder.offsets(ids))).hexdigest()


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
