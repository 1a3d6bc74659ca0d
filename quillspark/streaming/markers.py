"""Remove citation markers from token streams, across token boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import MARKER_RE

# The longest tail that waits, and what may still grow into a marker at the end of a text.
MAX_HELD = 128
_OPEN = re.compile(r"\[(?:c(?::[A-Za-z0-9_-]*)?)?$")

_MARKER = re.compile(MARKER_RE)


def cut_markers(held: str, tokens: list[str], final: bool) -> tuple[list[str], str]:
    """The tokens' texts without markers, and the tail that waits for more.

    All tokens are looked at as one text, which begins with the tail held before. Its markers, and unless
    ``final`` an unfinished one at its end, are taken out; what is left goes back to the tokens it came
    from, the held tail to the first.
    """
    text = held + "".join(tokens)
    gone = [m.span() for m in _MARKER.finditer(text)]
    tail = None if final else _OPEN.search(text, gone[-1][1] if gone else 0)
    if tail and len(text) - tail.start() >= MAX_HELD:
        tail = None
    kept = zip([0, *(end for _, end in gone)], [*(start for start, _ in gone), tail.start() if tail else len(text)], strict=True)
    ends = [len(held) + n for n in accumulate(map(len, tokens))]
    out: list[list[str]] = [[] for _ in tokens]
    for start, end in kept:
        while start < end:
            at = min(bisect_right(ends, start), len(tokens) - 1)
            stop = min(end, max(ends[at], start + 1))
            out[at].append(text[start:stop])
            start = stop
    return ["".join(parts) for parts in out], text[tail.start():] if tail else ""


def _strip_group(idle_ms: int | None):
    def strip(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ("", -1)
        if state.hasTimedOut:  # the answer was never ended: what it holds is text
            state.remove()
            rows = [(key[0], last, held)] if held else []
        else:
            # One micro-batch's tokens of one answer, put back into stream order.
            batch = pd.concat(list(frames), ignore_index=True).sort_values("seq")
            seq, ended = batch["seq"].tolist(), bool(batch["is_end"].fillna(False).any())
            texts, held = cut_markers(held, batch["token"].fillna("").tolist(), ended)
            rows = [(key[0], n, text) for n, text in zip(seq, texts, strict=True) if text]
            if ended:
                if state.exists:
                    state.remove()
            else:
                state.update((held, int(seq[-1])))
                if idle_ms:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["message_id", "seq", "text"])

    return strip


def strip_stream(tokens: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``tokens(message_id, seq, token, is_end)`` to ``(message_id, seq, text)``.

    The state per answer is a tail under 128 characters. The row with ``is_end`` releases it and drops the
    state; so does ``idle_ms`` without a token, where given, under the number of the last token. A query
    with such a timer runs on until it is stopped; one that is to end with its input has none. Tokens of one
    answer arrive in order from one micro-batch to the next.
    """
    return (
        tokens.select("message_id", "seq", "token", "is_end").groupBy("message_id")
        .applyInPandasWithState(
            _strip_group(idle_ms), "message_id string, seq bigint, text string", "held string, last bigint",
            "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
        )
    )
