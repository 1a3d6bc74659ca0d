"""Whole search jobs: JSON arguments in, context text, spans and error rows out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .context import EXPANSION_WINDOW, expand_and_merge, search_text
from .embedding import Embedder, embed
from .index import Index
from .search import (
    DEFAULT_SOURCE_TYPE, MAX_PER_DOCUMENT, RRF_K, cap_per_document, citation_rows, hit_rows, hybrid_topk, keyword_topk,
    parse_query_args, vector_topk,
)


class Answers(NamedTuple):
    """``answers(query_id, ok, error, n_results, text)`` and the spans behind the texts."""

    answers: DataFrame
    spans: DataFrame


def _search(args: DataFrame, index: Index, rank, embedded: bool, window: int, max_per_document: int,
            embedder: Embedder | None) -> Answers:
    parsed = settle(parse_query_args(args.select("query_id", "arguments")).drop("arguments"), "arguments")
    queries = parsed.where(F.col("error").isNull()).select("query_id", "query", "top_k")
    if embedded:
        # Equal questions are embedded once, by the model and to the length of the index.
        index.check_embedder(embedder)
        vectors = embed(queries.select("query").distinct(), "query", "embedding", index.settings["dim"], embedder)
        queries = settle(queries.join(vectors, "query"), "queries")
    hits = cap_per_document(hit_rows(rank(queries), index.chunks), max_per_document)
    spans = expand_and_merge(citation_rows(hits), index.chunks, window)
    texts = search_text(queries, spans)
    answers = parsed.join(texts, "query_id", "left").select(
        "query_id", F.col("error").isNull().alias("ok"), "error",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "text",
    )
    return Answers(answers, spans)


def keyword_search(args: DataFrame, index: Index, allowed: Sequence[str] | None = None,
                   default_source: str | None = DEFAULT_SOURCE_TYPE, window: int = EXPANSION_WINDOW,
                   max_per_document: int = MAX_PER_DOCUMENT) -> Answers:
    """Answer ``args(query_id, arguments)`` by BM25."""
    return _search(
        args, index, lambda q: keyword_topk(q, index, allowed=allowed, default_source=default_source),
        False, window, max_per_document, None,
    )


def semantic_search(args: DataFrame, index: Index, allowed: Sequence[str] | None = None,
                    default_source: str | None = DEFAULT_SOURCE_TYPE, window: int = EXPANSION_WINDOW,
                    max_per_document: int = MAX_PER_DOCUMENT, embedder: Embedder | None = None) -> Answers:
    """Answer ``args(query_id, arguments)`` by cosine similarity."""
    return _search(
        args, index, lambda q: vector_topk(q, index.vectors, allowed=allowed, default_source=default_source),
        True, window, max_per_document, embedder,
    )


def hybrid_search(args: DataFrame, index: Index, allowed: Sequence[str] | None = None,
                  default_source: str | None = DEFAULT_SOURCE_TYPE, window: int = EXPANSION_WINDOW,
                  max_per_document: int = MAX_PER_DOCUMENT, rrf_k: int = RRF_K,
                  embedder: Embedder | None = None) -> Answers:
    """Answer ``args(query_id, arguments)`` by both, fused by rank."""
    return _search(
        args, index, lambda q: hybrid_topk(q, index, allowed=allowed, default_source=default_source, rrf_k=rrf_k),
        True, window, max_per_document, embedder,
    )
