"""Conversations and messages: listings, ownership, previews, pairs, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import auto_title, export_name, is_blank, iso_utc, sources_markdown, strip
from ..session import broadcast_if_small
from .ordered import last_before, running_sum

EXPORT_TURNS = 1000


def conversation_list(conversations: DataFrame, messages: DataFrame, user_id: str | None = None) -> DataFrame:
    """Conversations with the text of their latest message, null when they have none."""
    if user_id is not None:
        conversations = conversations.where(F.col("user_id") == user_id)
        messages = messages.join(conversations.select("conversation_id"), "conversation_id", "left_semi")
    latest = messages.groupBy("conversation_id").agg(
        F.max_by("content", F.struct("created_at", "message_id")).alias("preview")
    )
    return conversations.join(latest, "conversation_id", "left")


def visible_conversations(listed: DataFrame, query: str = "") -> DataFrame:
    """Conversations that have messages; a query also filters their titles literally."""
    shown = listed.where(F.col("preview").isNotNull())
    if query.strip():
        shown = shown.where(F.contains(F.lower("title"), F.lower(F.lit(query.strip()))))
    return shown


def search_conversations(conversations: DataFrame, query: str, limit: int = 20,
                         user_id: str | None = None) -> DataFrame:
    """Most recently updated conversations with a title LIKE ``%query%``, case ignored."""
    if user_id is not None:
        conversations = conversations.where(F.col("user_id") == user_id)
    return (
        conversations.where(F.col("title").ilike(f"%{query}%"))
        .orderBy(F.desc("updated_at"), "conversation_id").limit(limit)
        .select("conversation_id", "title", "created_at", "updated_at")
    )


def titled_conversations(conversations: DataFrame, messages: DataFrame, order: str = "turn") -> DataFrame:
    """Give conversations that still have the default title one made of their first user message."""
    first = (
        messages.where(F.col("role") == "user").groupBy("conversation_id")
        .agg(F.min_by(strip("content"), order).alias("_first"))
    )
    return (
        conversations.join(first, "conversation_id", "left")
        .withColumn("title", auto_title("title", "_first")).drop("_first")
    )


def owned_messages(requests: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the requested ``(user_id, conversation_id)`` pairs that really belong together."""
    owned = requests.select("user_id", "conversation_id").distinct().join(
        conversations.select("user_id", "conversation_id"), ["user_id", "conversation_id"], "left_semi"
    )
    return messages.join(broadcast_if_small(owned), "conversation_id")


def with_feedback_flag(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add ``feedback_submitted``: at least one feedback row names the message."""
    named = feedback.select("message_id").distinct().withColumn("_f", F.lit(True))
    return messages.join(named, "message_id", "left").withColumn(
        "feedback_submitted", F.coalesce("_f", F.lit(False))
    ).drop("_f")


def conversation_detail(requests: DataFrame, conversations: DataFrame, messages: DataFrame, feedback: DataFrame,
                        order: str = "turn") -> DataFrame:
    """Requested ``(user_id, conversation_id)`` conversations with their messages in order.

    Output: user_id, conversation_id, title, position (from 0, null without messages), message_id, role, content,
    feedback_submitted. A request for a conversation of someone else, or for none, gives no row.
    """
    owned = requests.select("user_id", "conversation_id").distinct().join(
        conversations.select("user_id", "conversation_id", "title"), ["user_id", "conversation_id"])
    flagged = with_feedback_flag(messages.join(owned.select("conversation_id"), "conversation_id", "left_semi"), feedback)
    numbered = running_sum(flagged, ["conversation_id"], order, F.lit(1), "_nth").withColumn("position", F.col("_nth") - 1)
    return owned.join(numbered, "conversation_id", "left").select(
        "user_id", "conversation_id", "title", "position", "message_id", "role", "content", "feedback_submitted")


def guarded_messages(new: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new messages into accepted and rejected.

    Accepted ones have text, a known role, and a conversation of the same user.
    """
    keys = ["conversation_id", "user_id"]
    owners = conversations.select(*keys)
    fine = ~is_blank("content") & F.col("role").isin("user", "assistant")
    accepted = new.where(fine).join(owners, keys, "left_semi")
    rejected = new.where(~F.coalesce(fine, F.lit(False))).unionByName(new.where(fine).join(owners, keys, "left_anti"))
    return accepted, rejected


def touch(conversations: DataFrame, accepted: DataFrame) -> DataFrame:
    """Move ``updated_at`` to the latest accepted message."""
    latest = accepted.groupBy("conversation_id").agg(F.max("created_at").alias("_t"))
    return conversations.join(latest, "conversation_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_t")
    ).drop("_t")


def question_answer_pairs(messages: DataFrame, order: str = "turn") -> DataFrame:
    """Assistant messages with the nearest user text before them, null when there is none."""
    question = F.when(F.col("role") == "user", F.col("content"))
    return (
        last_before(messages, ["conversation_id"], order, question, "question")
        .where(F.col("role") == "assistant").withColumnRenamed("content", "answer")
    )


def delete_cascade(deleted: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows whose key was deleted."""
    gone = broadcast_if_small(deleted.select(key).distinct())
    return [t.join(gone, key, "left_anti") for t in tables]


def delete_conversations(deleted: DataFrame, conversations: DataFrame, messages: DataFrame,
                         feedback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and feedback that remain after deleting conversations."""
    return tuple(delete_cascade(deleted, "conversation_id", conversations, messages, feedback))


def conversation_markdown(conversations: DataFrame, messages: DataFrame, exported_at: Column,
                          order: str = "turn", part_turns: int = EXPORT_TURNS) -> DataFrame:
    """Each conversation as markdown: ``conversation_id, file_name, part, markdown``.

    The text of a conversation is its parts joined in order. Only the first part
    has the header; a part holds ``part_turns`` turns, so no conversation, however
    long, has to fit in one task.
    """
    sources = sources_markdown("sources") if "sources" in messages.columns else F.lit("")
    speaker = F.when(F.col("role") == "user", F.lit("**You:** ")).otherwise(F.lit("**Assistant:** "))
    turns = messages.select(
        "conversation_id", F.col(order).alias("_o"),
        F.floor(F.col(order) / F.lit(part_turns)).cast("bigint").alias("part"),
        F.concat(speaker, F.coalesce("content", F.lit("")), sources, F.lit("\n\n")).alias("_t"),
    )
    bodies = turns.groupBy("conversation_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "").alias("_body")
    )
    header = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), iso_utc(exported_at), F.lit("\n\n---\n\n"))
    heads = conversations.select("conversation_id", "title", F.lit(0).cast("bigint").alias("part"), header.alias("_head"))
    names = conversations.select("conversation_id", export_name("title", exported_at).alias("file_name"))
    parts = bodies.join(heads.drop("title"), ["conversation_id", "part"], "full")
    return parts.join(names, "conversation_id").select(
        "conversation_id", "file_name", "part",
        F.concat(F.coalesce("_head", F.lit("")), F.coalesce("_body", F.lit(""))).alias("markdown"),
    )
