"""Queries over an index that was changed after it was built: sync, change, delete, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live_index, search
from ..session import new_work_dir
from . import tables as T
from .registry import query
from .retrieval import BM25, TERMS, VECTORS, search_queries

_INDEXES: dict[tuple[str, str], live_index.LiveIndex] = {}

# What is left after the runs of ``changed_index``: labelled documents were written anew, those of quality 0 deleted.
LIVE = """
live_documents AS (
  SELECT doc_id, lang, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'revised ' || text || chr(10) || 'closing words' ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)
)"""
LIVE_CHUNKS = (LIVE, T.DOCS.replace("FROM documents", "FROM live_documents"), T.CHUNKS)


def changed_index(spark, sf_dir) -> live_index.LiveIndex:
    """Built over the unlabelled documents and the old texts of labelled ones; then the new texts come and documents go."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        docs, labels = T.load(spark, sf_dir, "documents"), T.load(spark, sf_dir, "labels")
        index = live_index.create(T.doc_chunks(spark, sf_dir), new_work_dir(spark, "live-index"))
        revised = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").withColumn(
            "text", F.concat(F.lit("revised "), "text", F.lit("\nclosing words")))
        index.apply(T.doc_chunks(spark, sf_dir, revised))
        index.delete(labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("document_id")))
        _INDEXES[key] = index
    return _INDEXES[key]


@query(T.with_ctes(*LIVE_CHUNKS, TERMS) + """
SELECT t.term, t.df, s.n_chunks, round(s.avg_dl, 6) AS avg_dl FROM df t CROSS JOIN stats s""")
def maintained_stats(spark, sf_dir):
    """Document frequencies and sizes as sums of the runs' changes."""
    index = changed_index(spark, sf_dir)
    stats = index.corpus_stats.withColumn("_one", F.lit(1))
    return index.term_stats.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").drop("_one").withColumn("avg_dl", F.round("avg_dl", 6))


@query(T.with_ctes(*LIVE_CHUNKS, BM25) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""", ints=("rank",))
def maintained_keyword_topk(spark, sf_dir):
    hits = search.keyword_topk(search_queries(spark, sf_dir, False), changed_index(spark, sf_dir), 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(*LIVE_CHUNKS, VECTORS) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10""", ints=("rank",))
def maintained_semantic_topk(spark, sf_dir):
    hits = search.vector_topk(search_queries(spark, sf_dir), changed_index(spark, sf_dir).vectors, 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(*LIVE_CHUNKS) + "SELECT chunk_id, document_id, content FROM chunks")
def maintained_chunks(spark, sf_dir):
    """Live payload after a sync, a change and a delete, compacted into a new folder."""
    return changed_index(spark, sf_dir).compact(new_work_dir(spark, "compacted")).chunks.select("chunk_id", "document_id", "content")
