"""Retrieval queries: index statistics, top-k search, fusion, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, context, search
from ..operators.postings import build_postings
from ..operators.postings import keyword_topk_pruned as pruned_topk
from ..operators.embedding import DIM, embed
from ..operators.index import Index, build_index, chunk_term_rows, corpus_statistics, term_frequencies
from ..session import new_work_dir, settle
from . import tables as T
from .registry import query

_INDEXES: dict[tuple[str, str], Index] = {}


def corpus_index(spark, sf_dir) -> Index:
    """The index over all line chunks of ``documents``, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(T.doc_chunks(spark, sf_dir), new_work_dir(spark, "index"))
    return _INDEXES[key]


def search_queries(spark, sf_dir, embedded: bool = True):
    """Every benchmark text, whole, as a query."""
    rows = T.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return embed(rows, "query", "embedding") if embedded else rows


TERMS = """
chunk_terms AS (SELECT chunk_id, source_type, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS terms FROM chunks),
tf AS (SELECT chunk_id, source_type, term, dl, count(*) AS tf
       FROM (SELECT chunk_id, source_type, unnest(terms) AS term, len(terms) AS dl FROM chunk_terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n_chunks, sum(len(terms)) / count(*) AS avg_dl FROM chunk_terms)"""

BM25 = TERMS + """,
qtf AS (SELECT query_id, term, count(*) AS qtf
        FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
bm25_all AS (
  SELECT q.query_id, t.chunk_id, t.source_type,
         round(sum(ln(1 + (s.n_chunks - d.df + 0.5) / (d.df + 0.5)) * q.qtf * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avg_dl)))), 9) AS score
  FROM qtf q JOIN tf t USING (term) JOIN df d USING (term) CROSS JOIN stats s GROUP BY q.query_id, t.chunk_id, t.source_type
),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25_all)"""

VECTORS = f"""
slots AS (
  SELECT kind, id, source_type, slot, sum(sign) AS v FROM (
    SELECT kind, id, source_type, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {DIM} AS slot,
           CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1 ELSE 1 END AS sign
    FROM (SELECT 'c' AS kind, chunk_id AS id, source_type, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM chunks
          UNION ALL
          SELECT 'q', CAST(item_id AS VARCHAR), NULL, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) FROM benchmark)
  ) GROUP BY ALL
),
norms AS (SELECT kind, id, sqrt(sum(v * v)) AS norm FROM slots GROUP BY ALL HAVING sum(v * v) > 0),
cosine AS (
  SELECT CAST(q.id AS BIGINT) AS query_id, c.id AS chunk_id,
         round(coalesce(p.dot, 0) / (q.norm * c.norm), 9) AS score
  FROM (SELECT * FROM norms WHERE kind = 'q') q CROSS JOIN (SELECT * FROM norms WHERE kind = 'c') c
  LEFT JOIN (SELECT a.id AS qid, b.id AS cid, sum(a.v * b.v) AS dot FROM slots a JOIN slots b ON a.slot = b.slot
             AND a.kind = 'q' AND b.kind = 'c' GROUP BY ALL) p ON p.qid = q.id AND p.cid = c.id
),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosine)"""

RRF = """
fused AS (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
    SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 20 UNION ALL
    SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 20) GROUP BY query_id, chunk_id
),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)"""


def capped_sql(ranked: str, depth: str = "10") -> str:
    """CTEs from a ranked list to capped hits with their payload."""
    return f"""
hits AS (
  SELECT r.query_id, r.rank, r.score, c.*,
         row_number() OVER (PARTITION BY r.query_id, c.document_id ORDER BY r.rank) AS nth
  FROM {ranked} r JOIN chunks c USING (chunk_id) WHERE r.rank <= {depth}
),
capped AS (SELECT * FROM hits WHERE nth <= 3)"""


SPANS = """
wanted AS (SELECT DISTINCT query_id, document_id, chunk_index + d AS chunk_index FROM capped, (VALUES (-1), (0), (1)) AS t(d)),
near AS (
  SELECT w.query_id, c.*, h.chunk_id IS NOT NULL AS is_hit,
         c.chunk_index - row_number() OVER (PARTITION BY w.query_id, c.document_id ORDER BY c.chunk_index) AS island
  FROM wanted w JOIN chunks c ON c.document_id = w.document_id AND c.chunk_index = w.chunk_index
  LEFT JOIN capped h ON h.query_id = w.query_id AND h.chunk_id = c.chunk_id
),
best AS (SELECT query_id, document_id, min(rank) AS document_rank FROM capped GROUP BY ALL),
spans AS (
  SELECT n.query_id, n.document_id, b.document_rank, any_value(document_title) AS document_title,
         min(chunk_index) FILTER (is_hit) AS chunk_index, any_value(n.source_type) AS source_type,
         string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*) AS n_chunks
  FROM near n JOIN best b ON b.query_id = n.query_id AND b.document_id = n.document_id
  GROUP BY n.query_id, n.document_id, b.document_rank, island
),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_rank, chunk_index) AS position FROM spans)"""

TEXT = """
entries AS (
  SELECT query_id, count(*) AS n_results,
         string_agg('[c:' || document_id || '-' || chunk_index || '] ' || coalesce(nullif(document_title, ''), 'Unknown Document')
                    || ' › ' || source_type || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS text
  FROM placed GROUP BY query_id
)
SELECT b.item_id AS query_id, coalesce(e.n_results, 0) AS n_results,
       coalesce(e.text, 'No relevant chunks found. Try a different query or strategy.') AS text
FROM benchmark b LEFT JOIN entries e ON e.query_id = b.item_id"""


# --- index -----------------------------------------------------------------------------


@query(T.with_ctes(T.DOCS, T.CHUNKS, TERMS) + """
SELECT t.term, t.df, s.n_chunks, round(s.avg_dl, 6) AS avg_dl FROM df t CROSS JOIN stats s""")
def bm25_stats(spark, sf_dir):
    rows = settle(chunk_term_rows(T.doc_chunks(spark, sf_dir)), "chunk-terms")  # tokenised once for both
    stats = corpus_statistics(rows).withColumn("_one", F.lit(1))
    return (
        term_frequencies(rows).withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").drop("_one")
        .withColumn("avg_dl", F.round("avg_dl", 6))
    )


@query(T.with_ctes(T.DOCS, T.CHUNKS, TERMS) + "SELECT chunk_id, term, CAST(dl AS INTEGER) AS dl, CAST(tf AS INTEGER) AS tf FROM tf")
def index_postings(spark, sf_dir):
    rows = corpus_index(spark, sf_dir).chunk_terms
    return rows.select("chunk_id", "dl", F.explode("terms").alias("t")).select("chunk_id", "dl", "t.term", "t.tf")


@query(T.with_ctes(T.DOCS, T.CHUNKS, VECTORS) + """
SELECT id AS chunk_id, CAST(slot AS INTEGER) AS slot, CAST(v AS DOUBLE) AS value FROM slots WHERE kind = 'c' AND v <> 0""")
def embedded_chunks(spark, sf_dir):
    rows = embed(T.doc_chunks(spark, sf_dir).select("chunk_id", "content"))
    return rows.select("chunk_id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select(
        "chunk_id", "slot", F.col("value").cast("double").alias("value")
    )


# --- top-k ---------------------------------------------------------------------------------


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""", ints=("rank",))
def keyword_topk(spark, sf_dir):
    hits = search.keyword_topk(search_queries(spark, sf_dir, False), corpus_index(spark, sf_dir), 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""", ints=("rank",))
def keyword_topk_shuffled(spark, sf_dir):
    """The way taken when the query batch is too large to broadcast; same rows."""
    hits = search.keyword_topk(
        search_queries(spark, sf_dir, False), corpus_index(spark, sf_dir), 10, default_source=None, force_shuffle=True
    )
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25) + """
, allowed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS nth
              FROM bm25_all WHERE source_type IN ('src1', 'src4'))
SELECT query_id, chunk_id, nth AS rank, round(score, 6) AS score FROM allowed WHERE nth <= 10""", ints=("rank",))
def keyword_topk_allowed(spark, sf_dir):
    hits = search.keyword_topk(
        search_queries(spark, sf_dir, False), corpus_index(spark, sf_dir), 10, allowed=["src1", "src4"]
    )
    return hits.withColumn("score", F.round("score", 6))


_WITH_POSTINGS: set[tuple[str, str]] = set()


def index_with_postings(spark, sf_dir) -> Index:
    index, key = corpus_index(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _WITH_POSTINGS:
        build_postings(index)
        _WITH_POSTINGS.add(key)
    return index


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""", ints=("rank",))
def keyword_topk_pruned(spark, sf_dir):
    """The same rows, without the postings of terms that cannot decide."""
    hits = pruned_topk(search_queries(spark, sf_dir, False), index_with_postings(spark, sf_dir), 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25) + """
, allowed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS nth
              FROM bm25_all WHERE source_type IN ('src1', 'src4'))
SELECT query_id, chunk_id, nth AS rank, round(score, 6) AS score FROM allowed WHERE nth <= 10""", ints=("rank",))
def keyword_topk_pruned_allowed(spark, sf_dir):
    hits = pruned_topk(search_queries(spark, sf_dir, False), index_with_postings(spark, sf_dir), 10, allowed=["src1", "src4"])
    return hits.withColumn("score", F.round("score", 6))


@query(T.with_ctes(T.DOCS, T.CHUNKS, VECTORS) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10""", ints=("rank",))
def semantic_topk(spark, sf_dir):
    hits = search.vector_topk(search_queries(spark, sf_dir), corpus_index(spark, sf_dir).vectors, 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


@query("""
WITH centers AS (SELECT label, i, avg(x) AS m FROM (
       SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
q AS (SELECT label AS query_id, list(CAST(m AS DOUBLE) ORDER BY i) AS v FROM centers GROUP BY label),
scored AS (SELECT q.query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id,
                  round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q CROSS JOIN embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""", ints=("rank",))
def vector_topk_by_label(spark, sf_dir):
    """The stored vectors nearest to each label's mean vector."""
    vectors = T.load(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("embedding"))
    )
    stored = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return search.vector_topk(means, stored, 10, default_source=None).withColumn("score", F.round("score", 6))


@query("""
WITH centers AS (SELECT label, i, avg(x) AS m FROM (
       SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
q AS (SELECT label AS query_id, list(CAST(m AS DOUBLE) ORDER BY i) AS v FROM centers GROUP BY label),
scored AS (SELECT q.query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id,
                  round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q CROSS JOIN embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100""", ints=("rank",))
def vector_topk_deep(spark, sf_dir):
    """The stored vectors nearest to each label's mean vector."""
    vectors = T.load(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("embedding"))
    )
    stored = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return search.vector_topk(means, stored, 100, default_source=None).withColumn("score", F.round("score", 6))


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, VECTORS, RRF) + """
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rrf WHERE rank <= 10""", ints=("rank",))
def hybrid_rrf_topk(spark, sf_dir):
    hits = search.hybrid_topk(search_queries(spark, sf_dir), corpus_index(spark, sf_dir), 10, default_source=None)
    return hits.withColumn("score", F.round("score", 6))


# --- hits to context ------------------------------------------------------------------------


def _hits(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    ranked = search.keyword_topk(search_queries(spark, sf_dir, False), index, 10, default_source=None)
    return search.hit_rows(ranked, index.chunks)


def _capped(spark, sf_dir):
    return search.cap_per_document(_hits(spark, sf_dir))


def _spans(spark, sf_dir):
    return context.expand_and_merge(search.citation_rows(_capped(spark, sf_dir)), corpus_index(spark, sf_dir).chunks)


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25")) + """
SELECT query_id, rank, chunk_id, document_id, document_title, document_url, source_type, content,
       section_path AS breadcrumb, anchor, chunk_index, length(content) AS char_end, round(score, 6) AS score FROM hits""", ints=("rank",))
def hit_shape(spark, sf_dir):
    return _hits(spark, sf_dir).select(
        "query_id", "rank", "chunk_id", "document_id", "document_title", "document_url", "source_type", "content",
        F.array_join("section_path", " › ").alias("breadcrumb"), "anchor", "chunk_index",
        F.col("char_end").cast("bigint").alias("char_end"), F.round("score", 6).alias("score"),
    )


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25")) + "SELECT query_id, rank, chunk_id, document_id FROM capped", ints=("rank",))
def capped_hits(spark, sf_dir):
    return _capped(spark, sf_dir).select("query_id", "rank", "chunk_id", "document_id")


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25")) + """
SELECT query_id, rank, chunk_id, content, document_id, document_title, document_url, CAST(NULL AS VARCHAR) AS document_content_path,
       source_type, section_path AS breadcrumb, anchor, chunk_index FROM capped""", ints=("rank",))
def citation_shape(spark, sf_dir):
    rows = search.citation_rows(_capped(spark, sf_dir))
    return rows.withColumn("breadcrumb", F.array_join("section_path", " › ")).drop("section_path")


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25")) + """
SELECT DISTINCT h.query_id, c.chunk_id, c.content FROM capped h
JOIN chunks c ON c.document_id = h.document_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1""")
def neighbours(spark, sf_dir):
    hits = search.citation_rows(_capped(spark, sf_dir))
    return context.neighbours(hits, corpus_index(spark, sf_dir).chunks).select("query_id", "chunk_id", "content")


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25"), SPANS) + """
SELECT query_id, position, document_id, document_rank, document_title, chunk_index, source_type, content, n_chunks FROM placed""", ints=("position", "document_rank"))
def expanded_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select(
        "query_id", "position", "document_id", "document_rank", "document_title", "chunk_index", "source_type", "content", "n_chunks"
    )


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, capped_sql("bm25"), SPANS, TEXT))
def search_text(spark, sf_dir):
    return context.search_text(search_queries(spark, sf_dir, False), _spans(spark, sf_dir))


def _composite(spark, sf_dir, ranked):
    index, queries = corpus_index(spark, sf_dir), search_queries(spark, sf_dir, False)
    hits = search.cap_per_document(search.hit_rows(ranked, index.chunks))
    return context.search_text(queries, context.expand_and_merge(search.citation_rows(hits), index.chunks))


@query(T.with_ctes(T.DOCS, T.CHUNKS, VECTORS, capped_sql("dense"), SPANS, TEXT))
def semantic_search_text(spark, sf_dir):
    ranked = search.vector_topk(search_queries(spark, sf_dir), corpus_index(spark, sf_dir).vectors, 10, default_source=None)
    return _composite(spark, sf_dir, ranked)


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, VECTORS, RRF, capped_sql("rrf"), SPANS, TEXT))
def hybrid_search_text(spark, sf_dir):
    ranked = search.hybrid_topk(search_queries(spark, sf_dir), corpus_index(spark, sf_dir), 10, default_source=None)
    return _composite(spark, sf_dir, ranked)


@query("""
WITH args AS (
  SELECT event_id, CASE event_type
    WHEN 'view' THEN '{"query": "  ' || event_type || ' ' || user_id || ' ", "top_k": ' || (event_id % 50) || '}'
    WHEN 'click' THEN '{"query": "q", "top_k": "' || (event_id % 50) || '"}'
    WHEN 'purchase' THEN '{"top_k": ' || (event_id % 9) || '.7}'
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '[1, 2]' ELSE '{"query": ' END
    ELSE CASE WHEN event_id % 2 = 0 THEN '   ' ELSE '{"query": "x", "top_k": null, "props": ' || props || '}' END END AS a, *
  FROM events
)
SELECT event_id, CASE event_type WHEN 'view' THEN event_type || ' ' || user_id WHEN 'click' THEN 'q' WHEN 'error' THEN
                   CASE WHEN event_id % 2 = 1 THEN 'x' END END AS query,
       CAST(CASE WHEN event_type IN ('view', 'click') THEN greatest(1, least(30, event_id % 50)) WHEN event_type = 'purchase' THEN greatest(1, event_id % 9)
            WHEN event_type = 'error' THEN 10 END AS INTEGER) AS top_k,
       CASE WHEN event_type = 'signup' THEN 'invalid JSON arguments'
            WHEN event_type = 'purchase' OR (event_type = 'error' AND event_id % 2 = 0) THEN 'missing required parameter: query' END AS error
FROM args""")
def query_args(spark, sf_dir):
    n = F.col("event_id")
    even = n % 2 == 0

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    raw = (
        F.when(F.col("event_type") == "view", cat('{"query": "  ', F.col("event_type"), " ", F.col("user_id").cast("string"), ' ", "top_k": ', (n % 50).cast("string"), "}"))
        .when(F.col("event_type") == "click", cat('{"query": "q", "top_k": "', (n % 50).cast("string"), '"}'))
        .when(F.col("event_type") == "purchase", cat('{"top_k": ', (n % 9).cast("string"), ".7}"))
        .when(F.col("event_type") == "signup", F.when(even, F.lit("[1, 2]")).otherwise(F.lit('{"query": ')))
        .otherwise(F.when(even, F.lit("   ")).otherwise(cat('{"query": "x", "top_k": null, "props": ', F.col("props"), "}")))
    )
    events = T.load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    return search.parse_query_args(events.withColumn("arguments", raw)).select("event_id", "query", "top_k", "error")


# --- whole search jobs -----------------------------------------------------------------------

ARGS = """
args AS (
  SELECT item_id AS query_id, greatest(1, least(30, item_id % 35)) AS k,
         CASE item_id % 9 WHEN 3 THEN 'invalid JSON arguments' WHEN 5 THEN 'missing required parameter: query' END AS error
  FROM benchmark
)"""

DEPTH = "(SELECT CASE WHEN a.error IS NULL THEN a.k * %d ELSE 0 END FROM args a WHERE a.query_id = r.query_id)"

ANSWERS = TEXT[:TEXT.index("SELECT b.item_id")] + """
SELECT a.query_id, a.error IS NULL AS ok, a.error, CASE WHEN a.error IS NULL THEN coalesce(e.n_results, 0) ELSE 0 END AS n_results,
       CASE WHEN a.error IS NULL THEN coalesce(e.text, 'No relevant chunks found. Try a different query or strategy.') END AS text
FROM args a LEFT JOIN entries e USING (query_id)"""

FUSED_OWN_DEPTH = f"""
fused AS (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (
    SELECT query_id, chunk_id, rank FROM bm25 r WHERE rank <= {DEPTH % 2} UNION ALL
    SELECT query_id, chunk_id, rank FROM dense r WHERE rank <= {DEPTH % 2}) GROUP BY query_id, chunk_id
),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)"""


def _arguments(spark, sf_dir):
    """Every benchmark text as a tool call: own depths, some broken and some without a query."""
    n = F.col("item_id")
    good = F.to_json(F.struct(F.col("text").alias("query"), (n % 35).alias("top_k")))
    return T.load(spark, sf_dir, "benchmark").select(
        n.alias("query_id"),
        F.when(n % 9 == 3, F.concat(good, F.lit("]"))).when(n % 9 == 5, F.lit('{"top_k": 3}')).otherwise(good).alias("arguments"),
    )


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, ARGS, capped_sql("bm25", DEPTH % 1), SPANS, ANSWERS))
def keyword_answers(spark, sf_dir):
    return answers.keyword_search(_arguments(spark, sf_dir), corpus_index(spark, sf_dir), default_source=None).answers


@query(T.with_ctes(T.DOCS, T.CHUNKS, VECTORS, ARGS, capped_sql("dense", DEPTH % 1), SPANS, ANSWERS))
def semantic_answers(spark, sf_dir):
    return answers.semantic_search(_arguments(spark, sf_dir), corpus_index(spark, sf_dir), default_source=None).answers


@query(T.with_ctes(T.DOCS, T.CHUNKS, BM25, VECTORS, ARGS, FUSED_OWN_DEPTH, capped_sql("rrf", DEPTH % 1), SPANS, ANSWERS))
def hybrid_answers(spark, sf_dir):
    return answers.hybrid_search(_arguments(spark, sf_dir), corpus_index(spark, sf_dir), default_source=None).answers
