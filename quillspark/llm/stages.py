"""The stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

Each calls one operator of this package on all rows of ``docs``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import settle
from . import langid, near_copies, packing, quality, simhash, suffix_dedup
from .common import table

BATCH_BYTES = 4 << 20  # of an Arrow batch: both the JVM and the Python worker hold it whole, beside the executor's heap


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.5 or more)."""
    _bounded(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without letters or a clear language go."""
    _bounded(spark)
    return langid.keep(docs, langid.train(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    _bounded(spark)
    return simhash.keep_one(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, and of those one of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    _bounded(spark)
    return near_copies.keep_one(settle(simhash.keep_one(docs), "one-of-each-component"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that start earlier too."""
    _bounded(spark)
    return suffix_dedup.shorten(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, each with its sequence and offset."""
    _bounded(spark)
    return packing.pack(packing.pieces(docs))
