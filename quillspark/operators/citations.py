"""Resolve the citations of finished answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_ids, is_refusal, strip_markers
from ..schemas import CITATION_COLUMNS

MAX_UNCITED = 10


def first_seen(retrieved: DataFrame) -> DataFrame:
    """Drop repeats of a chunk within a message, keeping its first position; empty ids go."""
    return (
        retrieved.where(F.coalesce("chunk_id", F.lit("")) != "")
        .groupBy("message_id", "chunk_id")
        .agg(F.min_by(F.struct("*"), "pos").alias("r"))
        .select("r.*")
    )


def flag_cited(retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """Add ``is_cited``: the chunk's id stands in a marker of the message's final text."""
    markers = answers.select("message_id", F.explode(cited_ids("final_text")).alias("chunk_id"))
    return (
        retrieved.join(markers.withColumn("_cited", F.lit(True)), ["message_id", "chunk_id"], "left")
        .withColumn("is_cited", F.coalesce("_cited", F.lit(False))).drop("_cited")
    )


def collapse_by_document(flagged: DataFrame) -> DataFrame:
    """One citation per document and message, in first-seen order.

    ``is_cited`` is true when any chunk is; the row shown is the lowest
    ``chunk_index`` among the cited chunks, else among all.
    """
    return (
        flagged.groupBy("message_id", F.coalesce("document_id", F.lit("")).alias("_doc"))
        .agg(
            F.min_by(F.struct("*"), F.struct(~F.col("is_cited"), F.coalesce("chunk_index", F.lit(0)), "pos")).alias("r"),
            F.bool_or("is_cited").alias("_any"),
            F.min("pos").alias("_first"),
        )
        .select(
            "message_id", F.col("_first").alias("pos"),
            *[F.col(f"r.{c}").alias(c) for c in flagged.columns if c not in ("message_id", "pos", "is_cited")],
            F.col("_any").alias("is_cited"),
        )
    )


def select_sources(collapsed: DataFrame, max_uncited: int = MAX_UNCITED) -> DataFrame:
    """Cited documents first, then the first uncited ones; ``position`` counts from 1."""
    order = Window.partitionBy("message_id", "is_cited").orderBy("pos")
    kept = collapsed.withColumn("_n", F.row_number().over(order)).where(F.col("is_cited") | (F.col("_n") <= max_uncited))
    final = Window.partitionBy("message_id").orderBy(~F.col("is_cited"), "pos")
    return kept.withColumn("position", F.row_number().over(final)).drop("_n")


def resolve_citations(answers: DataFrame, retrieved: DataFrame, product: str = "product",
                      max_uncited: int = MAX_UNCITED) -> DataFrame:
    """Stored form of each answer: marker-free text and its ordered sources.

    ``answers(message_id, answer, final_text)``: the whole raw text and that of
    the final round. ``retrieved(message_id, pos, <citation columns>)``. Ids are
    read from the raw final text; a refusal has no sources. A turn's tool budget
    bounds the citations of one message.
    """
    chosen = select_sources(collapse_by_document(flag_cited(first_seen(retrieved), answers)), max_uncited)
    source = F.struct(*[F.col(c) for c in CITATION_COLUMNS if c in retrieved.columns], F.col("is_cited"))
    lists = chosen.groupBy("message_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", source.alias("s")))), lambda x: x["s"]).alias("sources")
    )
    refused = is_refusal("final_text", product)
    return answers.join(lists, "message_id", "left").select(
        "message_id", strip_markers("answer").alias("content"), refused.alias("is_refusal"),
        F.when(~refused, F.col("sources")).alias("sources"),
    )
