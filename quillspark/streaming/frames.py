"""Split a stream of text pieces into complete event-stream blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_blank
from ..operators.toolcalls import parse_event


def _split_group(idle_ms: int | None):
    def split(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number = state.get if state.exists else ("", 0)
        if state.hasTimedOut:  # the message was never ended: what it holds is its last block
            state.remove()
            blocks = [rest]
        else:
            pieces = sorted(((s, p) for part in frames for s, p in zip(part["seq"].tolist(), part["piece"].tolist(), strict=True)), key=lambda x: x[0])
            *blocks, rest = (rest + "".join(p for _, p in pieces if p is not None)).split("\n\n")
            if any("[DONE]" in block for block in blocks):  # fixed value: the block that ends a message
                if state.exists:
                    state.remove()
            else:
                state.update((rest, number + len(blocks)))
                if idle_ms:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({
            "message_id": [key[0]] * len(blocks), "block_no": range(number, number + len(blocks)), "raw": blocks,
        })

    return split


def event_stream(pieces: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``pieces(message_id, seq, piece)`` cut anywhere, to parsed blocks.

    Output: message_id, block_no, event, data, kind, text. The unfinished tail of
    each message is the only state, and goes with the block that ends the message; blank blocks are dropped.
    Where ``idle_ms`` is given, that long without a piece gives the tail as a last block and drops the state;
    a query with such a timer runs on until it is stopped.
    """
    blocks = pieces.select("message_id", "seq", "piece").groupBy("message_id").applyInPandasWithState(
        _split_group(idle_ms), "message_id string, block_no bigint, raw string", "rest string, number bigint",
        "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )
    return blocks.where(~is_blank("raw")).select("message_id", "block_no", parse_event("raw").alias("e")).select(
        "message_id", "block_no", "e.event", "e.data", "e.kind", "e.text"
    )
