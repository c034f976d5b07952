"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are
rendered whole; where an output begins with the one before it, the rest is the new turn's span, and
where it does not, the template rewrites history. No check of single turns can show that a black
box doesn't look further back, so only the shipped template, known to render each turn by itself,
costs a constant per turn: its prefixes restart every ``block`` turns from the turn before.

The shipped template marks turns by control strings and puts a backslash before each of them,
and before backslashes, inside texts, so that texts can be read back exactly.

Cases: rows are ordered by turn (nulls first), then role and text, so ties and repeated rows are
defined; null text and null role are empty; a null conv_id is a conversation of its own; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

TURN_START, TURN_END = "###", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_END = re.compile(r"\\(?:\\|###|</turn>)|(</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn_template(turns: list[Turn]) -> str:
    r"""``### role:\ntext</turn>\n`` per turn; line feeds in a role are written ``\n``."""
    return "".join([f"{TURN_START} {escape(role).replace(chr(10), chr(92) + 'n')}:\n{escape(text)}{TURN_END}\n" for role, text in turns])


def read_turn(span: str) -> tuple[str, str, int, int]:
    """(role, text, and where the escaped text lies in the span) of one rendered turn."""
    head, _, _ = span.partition("\n")
    start = len(head) + 1
    end = next(m.start() for m in _END.finditer(span, start) if m[1])
    role = re.sub(r"\\(n|\\|###|</turn>)", lambda m: "\n" if m[1] == "n" else m[1], head[len(TURN_START) + 1 : -1])
    return role, unescape(span[start:end]), start, end


def spans(turns: Iterable[Turn], render: Callable[[list[Turn]], str], block: int = 32) -> Iterator[tuple[str, bool]]:
    """(span, whether the new prefix rewrote the one before) of each turn; holds ``block`` turns.

    Only for templates known to look at no turn but the one before. Raises ``LooksBack`` if a restart
    doesn't agree with the longer prefix, which doesn't find every template that looks further back.
    """
    window: list[Turn] = []
    shown, last = render([]), None
    for turn in turns:
        if len(window) > block:
            window = window[-1:]
            fresh = render(window)
            if _new_part(render([]), fresh) != last:
                raise LooksBack
            shown = fresh
        window.append(turn)
        now = render(window)
        last = _new_part(shown, now)
        yield last
        shown = now


class LooksBack(ValueError):
    """The template's rendering of a turn depends on more than the turn before it."""


def _new_part(before: str, now: str) -> tuple[str, bool]:
    if now.startswith(before):
        return now[len(before) :], False
    same = next((k for k, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
    return now[same:], True


def whole_spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> Iterator[tuple[str, bool]]:
    shown = render([])
    for k in range(len(turns)):
        now = render(turns[: k + 1])
        yield _new_part(shown, now)
        shown = now


SPANS = "conv_id long, turn_no long, role string, span string, start long, loss_start long, loss_end long, rewrites boolean"


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = turn_template, loss_role: str = "assistant") -> DataFrame:
    """One row per turn of ``rows`` (conv_id, turn, role, text): its span of the formatted conversation.

    ``start`` is the span's place in the output; the loss mask covers its characters from loss_start
    to loss_end (equal: none). Rows of a conversation stay in order and together in a partition.
    """
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SPANS.split(", ")]
        out, held = [], 0
        for conv, turns in conversations(batches):
            at = 0
            for number, (role, (span, rewrites)) in enumerate(_robust(turns, template)):
                _, _, a, b = read_turn(span) if template is turn_template else ("", "", 0, len(span))
                if role != loss_role:
                    b = a
                out.append((conv, number, role, span, at, at + a, at + b, rewrites))
                at += len(span)
                held += len(span)
                if held > 1 << 22:
                    yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
                    out, held = [], 0
        yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(run, SPANS)


def conversations(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Each conversation's turns as a stream; the next conversation begins where its turns end."""
    rows = ((None if pd.isna(c) else int(c), r, t) for b in batches for c, r, t in zip(b["conv_id"], b["role"], b["text"]))
    ahead = next(rows, None)

    def turns(conv):
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            yield ahead[1:]
            ahead = next(rows, None)

    while ahead is not None:
        conv = ahead[0]
        mine = turns(conv)
        yield conv, mine
        for _ in mine:
            pass


def _robust(turns: Iterator[Turn], template) -> Iterator[tuple[str, tuple[str, bool]]]:
    if template is turn_template:  # known to look at no other turn
        seen: list[str] = []

        def noted():
            for turn in turns:
                seen.append(turn[0])
                yield turn

        for part in spans(noted(), template):
            yield seen.pop(), part
        return
    kept = list(turns)
    yield from zip([r for r, _ in kept], whole_spans(kept, template))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read back from the spans that ``format_conversations`` gives, in its order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DIGESTS.split(", ")]
        done: list[tuple] = []
        conv, state = None, None
        for batch in batches:
            for c, number, span, start, a, b in zip(*[batch[x] for x in ("conv_id", "turn_no", "span", "start", "loss_start", "loss_end")]):
                if number == 0:
                    if state is not None:
                        done.append(close(conv, state))
                    conv, state = (None if pd.isna(c) else int(c)), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _, _ = read_turn(span)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                under = unescape(span[a - start : b - start])
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(span)
            yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
            done = []
        if state is not None:
            yield pd.DataFrame([close(conv, state)], columns=columns).astype({"conv_id": "Int64"})

    def close(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    return formatted.mapInPandas(run, DIGESTS)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, len(regexp_extract_all(text, '\\|###|</turn>')) + len(regexp_extract_all(role, '\\|###|</turn>'))
    + len(role) - len(replace(role, chr(10), '')) AS escapes FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(role) + len(text) + escapes + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
