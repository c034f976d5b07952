"""A provider's event stream from raw pieces to restored events, and an audit of it, as one keyed stream.

Pieces are rows (request_id, seq, data, done) of a stream; a request's registry is rows (request_id,
token, value) of another one, as for ``chunks``. Only a payload's first choice is read, as rebuilt
events have one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskloom.functions.text import CLOSE, OPEN, WELL_FORMED
from maskloom.streaming.chunks import Scanner, sse_events
from maskloom.streaming.events import META, TOOLS

FRAME = 1 << 20
DONE = "[DONE]"


class Relay:
    """One response: pieces in, events out. ``saved`` is what ``state`` gave before."""

    def __init__(self, book: dict[str, str], saved: dict | None = None, longest: int = 64, marker: str = "[REDACTED]", frame: int = FRAME):
        s = saved or {"rest": "", "meta": {}, "scan": {}, "ended": False}
        self.rest, self.meta, self.scan, self.ended = s["rest"], s["meta"], s["scan"], s["ended"]
        self.book, self.longest, self.marker, self.frame = book, longest, marker, frame
        self.restored = self.unresolved = 0

    @property
    def state(self) -> dict:
        return {"rest": self.rest, "meta": self.meta, "scan": self.scan, "ended": self.ended}

    def push(self, data: str) -> list[str]:
        payloads, self.rest = sse_events(self.rest + data)
        if len(self.rest) > self.frame:  # a frame beyond the bound is read as it is, then forgotten
            more, _ = sse_events(self.rest + "\n\n")
            payloads, self.rest = payloads + more, ""
        return [e for p in payloads for e in self._event(p)]

    def finish(self) -> list[str]:
        """Events of what is held back, then the end mark."""
        if self.rest.strip():
            more, _ = sse_events(self.rest + "\n\n")
            self.rest = ""
            out = [e for p in more for e in self._event(p)]
        else:
            out = []
        for name in list(self.scan):
            out += self._text(name, "", True)
        self.scan, self.ended = {}, True
        return [*out, DONE]

    def _event(self, payload: str) -> list[str]:
        if self.ended or payload.strip() == DONE:
            return []
        try:
            body = json.loads(payload)
        except ValueError:
            return []
        if not isinstance(body, dict):
            return [payload]
        self.meta |= {m: body[m] for m in META if body.get(m) is not None}
        choices = body.get("choices")
        delta = choices[0].get("delta") if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
        if not isinstance(delta, dict):
            return [payload]
        out, routed = [], False
        for name, field in (("content", "content"), ("reasoning", "reasoning_content")):
            if isinstance(delta.get(field), str):
                routed = True
                out += self._text(name, delta[field])
        for at, call in enumerate(delta.get("tool_calls") or []):
            number = call.get("index", at)
            arguments = (call.get("function") or {}).get("arguments")
            if not isinstance(arguments, str) or number >= TOOLS:
                continue
            routed = True
            out += self._text(f"tool/{number}", arguments) if arguments else [payload]
        return out if routed else [payload]

    def _text(self, name: str, delta: str, last: bool = False) -> list[str]:
        scan = Scanner(self.book, self.longest, self.marker, tuple(self.scan.get(name, ("", False))))
        text = scan.push(delta) + (scan.finish() if last else "")
        self.scan[name] = list(scan.state)
        self.restored += scan.restored
        self.unresolved += scan.unresolved
        if not text:
            return []
        kind, _, number = name.partition("/")
        delta = {"content": text} if kind == "content" else {"reasoning_content": text} if kind == "reasoning" else {"tool_calls": [{"index": int(number), "function": {"arguments": text}}]}
        event = {m: self.meta.get(m) for m in META} | {"choices": [{"index": 0, "delta": delta, "finish_reason": None}]}
        return [json.dumps(event, ensure_ascii=False)]


class Audit:
    """Counts the sentinels of a stream whose pieces pass unchanged: well-formed and malformed ones."""

    def __init__(self, saved: dict | None = None):
        self.s = saved or {"held": "", "incomplete_restorations": 0, "blocked_outputs": 0}

    def push(self, data: str, longest: int = 4096) -> None:
        import re

        text = self.s["held"] + data
        while (at := text.find(OPEN)) >= 0 and (end := text.find(CLOSE, at)) >= 0:
            good = re.search(WELL_FORMED, text[at : end + 1]) is not None
            self.s["incomplete_restorations" if good else "blocked_outputs"] += 1
            text = text[end + 1 :]
        held = text[at:] if at >= 0 else ""
        self.s["held"] = held if len(held) < longest else ""

    def receipt(self) -> str:
        return json.dumps({k: self.s[k] for k in ("incomplete_restorations", "blocked_outputs")})


OUTPUT = "request_id string, seq long, kind string, event string, restored long, unresolved long"


def relay(pieces: DataFrame, registry: DataFrame | None = None, audit: bool = False, longest: int = 64, marker: str = "[REDACTED]", idle_ms: int | None = 600_000, most: int = 8 << 20) -> DataFrame:
    """(request_id, seq, kind, event, restored, unresolved) of a stream of ``pieces``.

    Restoring, ``event`` is an event's payload and the last one ``[DONE]``; pieces wait for their turn and for
    the request's first registry row. Auditing, each piece passes unchanged (kind ``piece``) and one row of kind
    ``receipt`` follows at its close. A request that is idle for ``idle_ms``, or has more than ``most`` characters waiting, is closed;
    a run that is to end by itself (``availableNow``) takes ``idle_ms`` None, as Spark goes on for time-outs.
    """
    columns = [F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "data", "done"]
    rows = pieces.select(*columns, F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("entry"))
    if registry is not None:
        none = [F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("data"), F.lit(False).alias("done")]
        rows = rows.unionByName(registry.select(F.col("request_id").cast("string").alias("request_id"), *none, "token", "value", F.lit(True).alias("entry")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"book": {} if audit else None, "wait": {}, "next": 0, "of": None}
        if not state.hasTimedOut:
            for batch in batches:
                for r in batch.itertuples():
                    if r.entry:
                        s["book"] = s["book"] or {}
                        if r.token is not None and r.value is not None:
                            s["book"][r.token] = r.value
                    elif r.seq >= s["next"]:
                        s["wait"][str(int(r.seq))] = [r.data or "", bool(r.done)]
        out, closed = [], state.hasTimedOut or sum(len(w[0]) for w in s["wait"].values()) > most
        if audit:
            count = Audit(s["of"])
            while not closed and (now := s["wait"].pop(str(s["next"]), None)) is not None:
                count.push(now[0])
                out.append((s["next"], "piece", now[0], 0, 0))
                s["next"] += 1
                closed = now[1]
            s["of"] = count.s
            if closed:
                out.append((s["next"], "receipt", count.receipt(), 0, 0))
        else:
            one = Relay(s["book"] or {}, s["of"], longest, marker)
            while not closed and s["book"] is not None and (now := s["wait"].pop(str(s["next"]), None)) is not None:
                before = one.restored, one.unresolved
                events = one.push(now[0]) + (one.finish() if now[1] else [])
                counts = [(one.restored - before[0], one.unresolved - before[1])] + [(0, 0)] * len(events)
                out += [(s["next"], "event", e, *c) for e, c in zip(events or [""], counts)] if events or any(counts[0]) else []
                s["next"] += 1
                closed = now[1]
            if closed and not one.ended:
                lost = bool(s["wait"])
                out += [(s["next"], "event", e, 0, int(lost) if k == 0 else 0) for k, e in enumerate(one.finish())]
            s["of"] = one.state
        if closed:
            state.remove()
        else:
            state.update((json.dumps(s),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["request_id", "seq", "kind", "event", "restored", "unresolved"])

    return rows.groupBy("request_id").applyInPandasWithState(step, OUTPUT, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def sse_lines(events: DataFrame) -> DataFrame:
    """(request_id, seq, line): the text a client receives for each event."""
    return events.select("request_id", "seq", F.concat(F.lit("data: "), "event", F.lit("\n\n")).alias("line"))


def finish_stats(events: DataFrame) -> DataFrame:
    """(request_id, restored, unresolved) summed over a batch of output rows."""
    return events.groupBy("request_id").agg(F.sum("restored").alias("restored"), F.sum("unresolved").alias("unresolved"))


def write_events(events: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append a stream's events as text lines of JSON under ``path``, exactly once."""
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
