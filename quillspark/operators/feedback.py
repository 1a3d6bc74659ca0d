"""Feedback on answers: validity, guarded insert, payload snapshot, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import report_body, report_title, strip
from .conversations import question_answer_pairs

MIN_CHARS = 10
MAX_CHARS = 5000


def valid_corrections(feedback: DataFrame) -> DataFrame:
    """Corrections of at least ten characters after trimming and at most five thousand."""
    text = F.col("suggested_correction")
    return feedback.where((F.length(strip(text)) >= MIN_CHARS) & (F.length(text) <= MAX_CHARS))


def guarded_feedback(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback whose target is an assistant message in a conversation of the same user."""
    targets = (
        messages.where(F.col("role") == "assistant").select("message_id", "conversation_id")
        .join(conversations.select("conversation_id", "user_id"), "conversation_id")
    )
    return feedback.join(targets, ["message_id", "conversation_id", "user_id"], "left_semi")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest feedback row of each message (combined before the shuffle)."""
    return (
        feedback.groupBy("message_id")
        .agg(F.max_by(F.struct("*"), F.struct("created_at", "feedback_id")).alias("f")).select("f.*")
    )


def payload_json(question: Column | str, answer: Column | str, sources: Column | str) -> Column:
    """Snapshot of the reported answer; every key is present, null where there is no value."""
    src = F.col(sources) if isinstance(sources, str) else sources
    citations = F.coalesce(
        F.transform(
            src,
            lambda s: F.struct(
                s["document_title"].alias("title"), s["document_url"].alias("url"),
                s["document_content_path"].alias("content_path"),
            ),
        ),
        F.array().cast("array<struct<title:string,url:string,content_path:string>>"),
    )
    q = F.col(question) if isinstance(question, str) else question
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.to_json(
        F.struct(q.alias("question"), a.alias("answer"), citations.alias("citations")),
        {"ignoreNullFields": "false"},
    )


def build_feedback_reports(feedback: DataFrame, messages: DataFrame, conversations: DataFrame,
                           order: str = "turn") -> DataFrame:
    """Reports for valid, guarded feedback on answers that follow a question.

    Output: feedback_id, message_id, conversation_id, question, payload_json, title, body.
    """
    accepted = guarded_feedback(valid_corrections(feedback), messages, conversations).select(
        "feedback_id", "message_id", "conversation_id", "suggested_correction"
    )
    named = accepted.select("conversation_id").distinct()  # only their conversations are put in order
    pairs = question_answer_pairs(messages.join(named, "conversation_id", "left_semi"), order).where(F.col("question").isNotNull()).select(
        "message_id", "conversation_id", "question", "answer",
        *(["sources"] if "sources" in messages.columns else []),
    )
    if "sources" not in messages.columns:
        empty = "array<struct<document_title:string,document_url:string,document_content_path:string>>"
        pairs = pairs.withColumn("sources", F.array().cast(empty))
    joined = accepted.join(pairs, ["message_id", "conversation_id"])
    return joined.select(
        "feedback_id", "message_id", "conversation_id", "question",
        payload_json("question", "answer", "sources").alias("payload_json"),
        report_title("question").alias("title"),
        report_body("question", "answer", "sources", "suggested_correction").alias("body"),
    )
