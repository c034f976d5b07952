"""Restoring sentinels in chunked text: keyed state that holds back what may still be one.

Chunks are rows (request_id, seq, channel, idx, delta, done), and the tokens a request emitted are rows
(request_id, token, value) of a second stream, so requests may begin at any time. A key group
has no row order, so chunks wait in state until their turn, and until a registry row of their request has come
(one with a null token says that it has no tokens). Output is cut so that no sentinel, and no bare body,
is ever split. An unclosed sentinel becomes the marker, the text behind it goes on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskloom.functions.text import BODY, CLOSE, MIDDLE, OPEN

_RUN = "[a-z2-7]"
_TAIL, _HEAD = re.compile(f"{_RUN}+$"), re.compile(f"{_RUN}*")
_PIECES = re.compile(f"{OPEN}[^{CLOSE}{OPEN}]*{CLOSE}|{OPEN}{_RUN}{{0,{BODY}}}{MIDDLE}?[A-Z]*|{CLOSE}|{_RUN}+")


class Scanner:
    """One channel's text; ``book`` maps the request's tokens to values. ``restored`` and ``unresolved`` count."""

    def __init__(self, book: dict[str, str], longest: int = 64, marker: str = "[REDACTED]", state: tuple[str, bool] = ("", False), bare: bool = True):
        self.book, self.longest, self.marker = book, longest, marker
        self.bodies = {t[1 : 1 + BODY]: v for t, v in book.items()} if bare else {}
        self.buffer, self.inside = state  # inside: a run too long for a body goes on
        self.restored = self.unresolved = 0

    @property
    def state(self) -> tuple[str, bool]:
        return self.buffer, self.inside

    def push(self, delta: str) -> str:
        """What may go out now."""
        self.buffer += delta
        done = ""
        if self.inside:
            n = _HEAD.match(self.buffer).end()
            done, self.buffer = self.buffer[:n], self.buffer[n:]
            self.inside = not self.buffer
        cut = len(self.buffer)
        open_at = self.buffer.rfind(OPEN)
        if open_at >= 0 and CLOSE not in self.buffer[open_at:] and len(self.buffer) - open_at < self.longest:
            cut = open_at  # a run before the mark ends there and is whole
        elif tail := _TAIL.search(self.buffer):
            if cut - tail.start() <= BODY:
                cut = tail.start()
            else:
                self.inside = True
        out, self.buffer = self.buffer[:cut], self.buffer[cut:]
        return done + self._restored(out)

    def finish(self) -> str:
        """What is left; a sentinel cut short becomes the marker."""
        out, self.buffer, self.inside = self.buffer, "", False
        return self._restored(out)

    def _restored(self, text: str) -> str:
        def value(m: re.Match) -> str:
            piece = m[0]
            if piece[0] not in (OPEN, CLOSE):
                known = self.bodies.get(piece) if len(piece) == BODY else None
                self.restored += known is not None
                return piece if known is None else known
            known = self.book.get(piece)
            if known is None:
                self.unresolved += 1
                return self.marker
            self.restored += 1
            return known

        return _PIECES.sub(value, text)


OUTPUT = "request_id string, channel string, idx int, seq long, text string, restored long, unresolved long"


class Channel:
    """Chunks of one channel in their order, restored once the request's registry is known."""

    def __init__(self, saved: dict | None, longest: int, marker: str, most: int):
        self.s = saved or {"book": None, "wait": {}, "next": 0, "scan": ["", False], "done": False}
        self.longest, self.marker, self.most = longest, marker, most

    def take(self, tokens: list[tuple[str | None, str | None]], chunks: list[tuple[int, str, bool]]) -> list[tuple[int, str, int, int]]:
        s = self.s
        for token, value in tokens:
            s["book"] = s["book"] or {}
            if token is not None and value is not None:
                s["book"][token] = value
        for seq, delta, done in chunks:
            if seq >= s["next"]:
                s["wait"][str(seq)] = [delta, done]
        return self.advance() if s["book"] is not None else self.bounded()

    def advance(self) -> list[tuple[int, str, int, int]]:
        s, out = self.s, []
        scan = Scanner(s["book"] or {}, self.longest, self.marker, tuple(s["scan"]))
        while not s["done"] and (now := s["wait"].pop(str(s["next"]), None)) is not None:
            before = scan.restored, scan.unresolved
            text = scan.push(now[0])
            if now[1]:
                s["done"], text = True, text + scan.finish()
            out.append((s["next"], text, scan.restored - before[0], scan.unresolved - before[1]))
            s["next"] += 1
        s["scan"] = list(scan.state)
        return out + self.bounded()

    def bounded(self) -> list[tuple[int, str, int, int]]:
        """Give up, visibly, when more waits than may be held."""
        return self.give_up() if sum(len(w[0]) for w in self.s["wait"].values()) > self.most else []

    def give_up(self) -> list[tuple[int, str, int, int]]:
        s = self.s
        lost = bool(s["wait"]) or bool(s["scan"][0])
        s["wait"], s["scan"], s["done"] = {}, ["", False], True
        return [(s["next"], self.marker, 0, 1)] if lost else []


def restore_chunks(chunks: DataFrame, registry: DataFrame, longest: int = 64, marker: str = "[REDACTED]", idle_ms: int | None = 600_000, most: int = 8 << 20) -> DataFrame:
    """Restored text per chunk; ``chunks`` and ``registry`` are streams (see above).

    State of a channel goes when it is done or idle for ``idle_ms``; what then waits, or waits beyond ``most``
    characters, becomes the marker and counts as unresolved. A run that is to end by itself (``availableNow``)
    takes ``idle_ms`` None, as Spark goes on for time-outs.
    """
    named = chunks.select(F.col("request_id").cast("string").alias("request_id"), "channel", F.col("idx").cast("int").alias("idx"), F.col("seq").cast("long").alias("seq"), "delta", "done", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("entry"))
    every = [("content", 0), ("reasoning", 0)] + [("tool", i) for i in range(32)]
    fan = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(i).alias("idx")) for c, i in every]))
    entries = registry.select(F.col("request_id").cast("string").alias("request_id"), "token", "value", fan.alias("c"))
    entries = entries.select("request_id", "c.channel", F.col("c.idx").cast("int").alias("idx"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("delta"), F.lit(False).alias("done"), "token", "value", F.lit(True).alias("entry"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel = Channel(json.loads(state.get[0]) if state.exists else None, longest, marker, most)
        if state.hasTimedOut:
            out = channel.give_up()
        else:
            tokens, parts = [], []
            for batch in batches:
                for r in batch.itertuples():
                    if r.entry:
                        tokens.append((r.token, r.value))
                    else:
                        parts.append((int(r.seq), r.delta or "", bool(r.done)))
            out = channel.take(tokens, parts)
        if state.hasTimedOut or channel.s["done"]:
            state.remove()
        else:
            state.update((json.dumps(channel.s),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, *r) for r in out], columns=["request_id", "channel", "idx", "seq", "text", "restored", "unresolved"])

    both = named.unionByName(entries)
    return both.groupBy("request_id", "channel", "idx").applyInPandasWithState(step, OUTPUT, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def sse_events(buffer: str) -> tuple[list[str], str]:
    """Payloads of the complete events of a buffer (``data:`` lines joined), and the rest."""
    out = []
    while True:
        for mark in ("\n\n", "\r\n\r\n"):
            if mark in buffer:
                event, buffer = buffer.split(mark, 1)
                break
        else:
            return out, buffer
        lines = [line.rstrip("\r")[5:].removeprefix(" ") for line in event.split("\n") if line.startswith("data:")]
        if lines:
            out.append("\n".join(lines))
