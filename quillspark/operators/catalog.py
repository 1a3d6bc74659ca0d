"""Listings over the document table: catalog, admin list, search, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_folded
from ..session import settle
from .ordered import global_rank

# The two lines above the numbered entries of a catalog block.
CATALOG_HEADER = (
    "Available documents in the library. Use `id=...` directly with get_document when a user "
    "references a page by title, topic, or identifier."
)

CATALOG_COLUMNS = (
    "document_id", "title", "description", "url", "content_path", "source_type", "lang",
    "last_crawled_at", "created_at",
)


def _present(df: DataFrame) -> list[str]:
    return [c for c in CATALOG_COLUMNS if c in df.columns]


def catalog(documents: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """All documents, newest first; ``allowed`` keeps the named source types only."""
    if allowed is not None:
        documents = documents.where(F.coalesce("source_type", F.lit("")).isin(*allowed)) if allowed else documents.where(F.lit(False))
    return documents.select(*_present(documents)).orderBy(F.desc("created_at"), "document_id")


def catalog_lines(documents: DataFrame, ordinal: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Numbered catalog entries, newest first, as rows ``(n, line)``.

    ``ordinal`` is a unique integer that grows with the creation time. Rows
    instead of one text keep a catalog of any size out of a single task; the
    block is ``CATALOG_HEADER``, a blank line, then the lines by ``n``.
    """
    if allowed is not None:
        documents = documents.where(F.coalesce("source_type", F.lit("")).isin(*allowed)) if allowed else documents.where(F.lit(False))
    ranked = global_rank(documents, ordinal, "n", descending=True)
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    where = F.coalesce(F.nullif("url", F.lit("")), F.nullif("content_path", F.lit("")))
    line = F.concat(
        F.col("n").cast("string"), F.lit(". "), title, F.lit(" (id="), F.col("document_id"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" — "), where), F.lit("")),
    )
    return ranked.select("n", line.alias("line"))


def documents_with_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, 0 included."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, "document_id", "left").select(
        *_present(documents), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )


def search_documents(documents: DataFrame, chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Newest documents whose title, description or url is LIKE ``%query%``.

    ``%`` and ``_`` in the query are wildcards; case is ignored.
    """
    pattern = f"%{query}%"
    hit = F.lit(False)
    for name in ("title", "description", "url"):
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    # At most ``limit`` rows: written once, then their chunks alone are counted.
    newest = settle(documents.where(hit).orderBy(F.desc("created_at"), "document_id").limit(limit), "newest")
    return documents_with_counts(newest, chunks.join(F.broadcast(newest.select("document_id")), "document_id", "left_semi"))


def filter_documents(documents: DataFrame, query: str) -> DataFrame:
    """Literal, case-folded filter over title, description, url and path joined by blanks."""
    if not query.strip():
        return documents
    return documents.where(contains_folded(["title", "description", "url", "content_path"], F.lit(query)))


def corpus_counts(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact numbers of documents, chunks and indexed vectors, one row per kind."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
             for name, df in (("documents", documents), ("chunks", chunks), ("vectors", vectors))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
