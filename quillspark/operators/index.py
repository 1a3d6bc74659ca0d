"""The search index: written tables derived from chunks.

``chunks``        payload, one row per chunk
``chunk_terms``   one row per chunk: length and distinct terms with counts
``vectors``       one row per chunk: the dense vector
``term_stats``    document frequency per term
``corpus_stats``  one row: number of chunks and their mean length
``settings``      one row: the term pattern, the vectors' length and the embedder's name

Terms are kept beside their chunk, so scoring a batch of queries is one scan
that never shuffles postings, and a term found in every chunk is not a hot key:
its postings are spread over all files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import TERM_RE, terms
from .embedding import DIM, Embedder, embed


@dataclass(frozen=True)
class Index:
    """Handles of one written index; every table is read from the shared folder."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def chunk_terms(self) -> DataFrame:
        return self._table("chunk_terms")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")

    @property
    def term_stats(self) -> DataFrame:
        return self._table("term_stats")

    @property
    def corpus_stats(self) -> DataFrame:
        return self._table("corpus_stats")

    @cached_property
    def settings(self) -> Row:
        """``term_re``, ``dim`` and ``embedder`` as the index was built with; searches take them from here."""
        return self._table("settings").first()

    def check_embedder(self, embedder: Embedder | None) -> None:
        if embedder_name(embedder) != self.settings["embedder"]:
            raise ValueError(f"the index was embedded by {self.settings['embedder']}, not by {embedder_name(embedder)}")


def embedder_name(embedder: Embedder | None) -> str:
    """The name a model is stored under; the built-in embedder has one of its own."""
    return "hashed" if embedder is None else getattr(embedder, "name", None) or getattr(embedder, "__qualname__", type(embedder).__qualname__)


def counted_terms(text: Column | str, term_re: str = TERM_RE) -> Column:
    """Distinct terms of a text with their counts, as ``array<struct<term,tf>>``.

    Counts are run lengths of the sorted terms, so no row leaves its task.
    """

    def runs(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
        heads = F.filter(placed, lambda x: (x["at"] == 0) | (x["term"] != F.get(words, x["at"] - 1)))
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda x, i: F.struct(
                    x["term"].alias("term"), (F.coalesce(F.get(h, i + 1)["at"], F.size(words)) - x["at"]).alias("tf")
                ),
            ),
        )

    return let(F.sort_array(terms(text, term_re)), runs)


def chunk_term_rows(chunks: DataFrame, term_re: str = TERM_RE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, source_type, dl, terms`` of each chunk, and its columns ``keep``; ``dl`` counts repeated terms."""
    return chunks.select("chunk_id", "source_type", counted_terms("content", term_re).alias("terms"), *keep).select(
        "chunk_id", "source_type",
        F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"]).alias("dl"),
        "terms", *keep,
    )


def term_frequencies(chunk_terms: DataFrame) -> DataFrame:
    """Number of chunks that hold each term (combined before the shuffle)."""
    return (
        chunk_terms.select(F.explode("terms.term").alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )


def corpus_statistics(chunk_terms: DataFrame) -> DataFrame:
    return chunk_terms.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        (F.sum(F.col("dl").cast("bigint")) / F.count(F.lit(1))).alias("avg_dl"),
    )


def build_index(chunks: DataFrame, path: str, dim: int = DIM, embedder: Embedder | None = None,
                term_re: str = TERM_RE) -> Index:
    """Write the index tables for ``chunks`` below ``path`` and return their handles.

    Each table is written once and the next is derived from the written one, so
    texts are tokenised a single time and a lost executor costs one task.
    """
    spark = chunks.sparkSession
    index = Index(spark, path)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunk_term_rows(index.chunks, term_re).write.mode("overwrite").parquet(f"{path}/chunk_terms")
    term_frequencies(index.chunk_terms).write.mode("overwrite").parquet(f"{path}/term_stats")
    corpus_statistics(index.chunk_terms).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    embed(index.chunks.select("chunk_id", "source_type", "content"), "content", "embedding", dim, embedder).select(
        "chunk_id", "source_type", "embedding"
    ).write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(term_re, dim, embedder_name(embedder))], "term_re string, dim int, embedder string").write.mode("overwrite").parquet(f"{path}/settings")
    return index
