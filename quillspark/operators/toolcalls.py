"""Logs of a chat turn: tool-call fragments, budgets, stream metrics, answer text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rstrip, strict_json

MAX_CALLS_PER_TURN = 6


def _last_filled(name: str) -> Column:
    filled = F.nullif(F.col(name), F.lit(""))
    return F.max_by(filled, F.when(filled.isNotNull(), F.col("seq")))


def assemble_tool_calls(fragments: DataFrame) -> DataFrame:
    """One row per call from its streamed fragments.

    ``fragments(turn_id, round, idx, seq, call_id, call_type, name, arguments)``:
    the last filled id, type and name win, arguments are joined in stream order.
    A group is the argument text of a single call.
    """
    return fragments.groupBy("turn_id", "round", "idx").agg(
        F.coalesce(_last_filled("call_id"), F.lit("")).alias("call_id"),
        F.coalesce(_last_filled("call_type"), F.lit("function")).alias("call_type"),
        F.coalesce(_last_filled("name"), F.lit("")).alias("name"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))),
                lambda x: x["a"],
            ),
            "",
        ).alias("arguments"),
    )


def cap_tool_calls(calls: DataFrame, max_calls: int = MAX_CALLS_PER_TURN) -> DataFrame:
    """Mark which calls of a turn run: the first ones by round and index, up to the budget.

    The allowed set is found with a bounded rank, so a turn with any number of
    calls is never sorted whole in one task.
    """
    order = Window.partitionBy("turn_id").orderBy("round", "idx")
    allowed = (
        calls.select("turn_id", "round", "idx").withColumn("call_no", F.row_number().over(order))
        .where(F.col("call_no") <= max_calls)
    )
    return calls.join(allowed, ["turn_id", "round", "idx"], "left").withColumn("capped", F.col("call_no").isNull())


def stream_metrics(deltas: DataFrame) -> DataFrame:
    """Per round: content deltas, distinct pending calls, calls made before, and the empty flag.

    ``deltas(turn_id, round, kind, idx)`` with kind ``content`` or ``tool_call``.
    """
    per_call = deltas.groupBy("turn_id", "round", "kind", "idx").agg(F.count(F.lit(1)).alias("n"))
    rounds = per_call.groupBy("turn_id", "round").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "content", F.col("n"))), F.lit(0)).alias("content_deltas"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls_pending"),
    )
    # A turn has few rounds: each needs a tool call and those are budgeted.
    before = Window.partitionBy("turn_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn(
        "tool_calls_made", F.coalesce(F.sum("tool_calls_pending").over(before), F.lit(0))
    ).withColumn("is_empty", F.col("content_deltas") == 0)


def frame_payload(frame: Column | str) -> Column:
    """Text a ``data:`` frame contributes to the answer; null for every other frame.

    Events, errors and the end mark give null, as does JSON that is not a
    string; a payload that is not JSON at all stands for itself.
    """
    raw = F.col(frame) if isinstance(frame, str) else frame
    payload = F.rtrim(F.substring(raw, 7, 2_147_483_647), F.lit("\n"))
    parsed = strict_json(payload)
    text = F.when(parsed.isNull(), payload).when(
        F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")
    )
    ignored = (payload == "") | (payload == "[DONE]") | payload.startswith('{"error"')
    return F.when(raw.startswith("data: ") & ~ignored, text)


def answer_text(frames: DataFrame) -> DataFrame:
    """Rebuild each answer from its frames; answers without any text are left out.

    A group is the frames of a single answer.
    """
    return (
        frames.select("message_id", "seq", frame_payload("frame").alias("t")).where("t is not null")
        .groupBy("message_id").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), ""
            ).alias("text")
        )
        .where(F.col("text") != "")
    )


def parse_event(raw: Column | str) -> Column:
    """One event-stream block as ``struct<event, data, kind, text>``.

    ``kind`` is sources, status, done, error, token or empty; ``text`` is the
    decoded token, the error message, or null.
    """
    block = F.col(raw) if isinstance(raw, str) else raw
    lines = F.split(block, "\n")
    names = F.filter(lines, lambda line: line.startswith("event:"))
    event = F.coalesce(
        F.trim(F.substring(F.try_element_at(names, F.lit(-1)), 7, 2_147_483_647)), F.lit("message")
    )
    data = F.array_join(
        F.transform(
            F.filter(lines, lambda line: line.startswith("data:")),
            lambda line: F.regexp_replace(line, "^data: ?", ""),
        ),
        "\n",
    )
    kind = (
        F.when(event == "sources", "sources").when(event == "status", "status")
        .when(data == "[DONE]", "done").when(data.startswith('{"error"'), "error")
        .when(data != "", "token").otherwise("empty")
    )
    parsed = strict_json(data)
    is_string = F.schema_of_variant(parsed) == "STRING"
    token = F.when(parsed.isNotNull() & is_string, F.try_variant_get(parsed, "$", "string")).otherwise(data)
    error = F.coalesce(F.nullif(F.try_variant_get(parsed, "$.error", "string"), F.lit("")), F.lit("Stream error from server"))
    text = F.when(kind == "token", token).when(kind == "error", error)
    return F.struct(event.alias("event"), rstrip(data).alias("data"), kind.alias("kind"), text.alias("text"))
