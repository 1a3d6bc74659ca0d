"""Reference-shaped tables derived from the given Parquet tables, in Spark and in SQL.

The given tables lack headings, markers, owners, feedback and fetch metadata.
They are derived by the same deterministic expressions on both sides, for every
row; nothing is filtered away. Where a merge needs an earlier state, the stored
side is a derived part of the rows, so that each outcome occurs; the incoming
side is always the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from ..operators.chunking import line_chunks

# A session on one machine may ask that tables which are a single file are spread over its cores.
SPREAD_CONF = "spark.quillspark.spreadFiles"
SITE = "https://docs.example.com/"
EPOCH = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is, in its own splits, whatever its size.

    ``SPREAD_CONF`` = true in a session deals every table out to the cores: for runs on one machine
    over files of a single row group, which cannot be split.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get(SPREAD_CONF, "false") == "true"
    return df.repartition(spark.sparkContext.defaultParallelism) if spread else df


# --- documents ---------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The ``documents`` table, or ``rows`` of its columns, as stored documents."""
    lines = F.split("text", "\n")
    return (load(spark, sf_dir, "documents") if rows is None else rows).select(
        F.col("doc_id").alias("doc_no"), F.col("doc_id").cast("string").alias("document_id"),
        F.element_at(lines, 1).alias("title"), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("description"),
        F.concat(F.lit(SITE), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("content_path"), F.col("source").alias("source_type"), "lang",
        F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit(EPOCH).cast("timestamp")).alias("created_at"),
        F.col("text").alias("body"),
    )


def doc_chunks(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Line chunks of all documents (or of ``rows``) with their document's payload."""
    docs = documents(spark, sf_dir, rows).withColumnsRenamed({"title": "document_title", "url": "document_url"})
    return line_chunks(docs, keep=("source_type", "document_title", "document_url")).withColumns({
        "section_path": F.array("source_type"),
        "anchor": F.concat(F.lit("line-"), F.col("chunk_index").cast("string")),
        "char_start": F.lit(0), "char_end": F.length("content"),
    })


def marked_lines(text: Column) -> Column:
    """Every fifth line becomes a heading of level 1, 2, 3, 1, …"""
    return F.array_join(
        F.transform(
            F.split(text, "\n"),
            lambda line, i: F.when(
                i % 5 == 0, F.concat(F.repeat(F.lit("#"), F.floor(i / 5).cast("int") % 3 + 1), F.lit(" "), line)
            ).otherwise(line),
        ),
        "\n",
    )


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("body", marked_lines(F.col("body")))


# SQL text of the same tables. `\n` is chr(10); lists count from 1.
WS = "'" + WHITESPACE + "'"

DOCS = f"""
docs AS (
  SELECT doc_id AS doc_no, CAST(doc_id AS VARCHAR) AS document_id,
         split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description,
         '{SITE}' || source || '/' || doc_id AS url, source AS source_type, lang,
         TIMESTAMP '{EPOCH}' + to_seconds(doc_id) AS created_at, text AS body
  FROM documents
)"""

CHUNKS = f"""
doc_lines AS (
  SELECT document_id, source_type, title, url,
         list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') AS ls
  FROM docs
),
chunks AS (
  SELECT document_id || '-' || chunk_index AS chunk_id, document_id, CAST(chunk_index AS INTEGER) AS chunk_index,
         source_type, title AS document_title, url AS document_url, content,
         source_type AS section_path, 'line-' || chunk_index AS anchor
  FROM (SELECT document_id, source_type, title, url, unnest(ls) AS content, unnest(range(len(ls))) AS chunk_index
        FROM doc_lines)
)"""

MARKED = """
md_lines AS (
  SELECT document_id, i, CASE WHEN i % 5 = 0 THEN repeat('#', CAST((i // 5) % 3 + 1 AS INTEGER)) || ' ' || line ELSE line END AS line
  FROM (SELECT document_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT document_id, string_split(body, chr(10)) AS ls FROM docs))
),
md_heads AS (
  SELECT document_id, i, off AS char_offset, length(regexp_extract(line, '^(#{1,6})[ \\t]+(.+?)[ \\t]*#*\\s*$', 1)) AS level,
         trim(regexp_extract(line, '^(#{1,6})[ \\t]+(.+?)[ \\t]*#*\\s*$', 2), %(ws)s) AS text
  FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM md_lines)
  WHERE regexp_matches(line, '^(#{1,6})[ \\t]+(.+?)[ \\t]*#*\\s*$')
),
md_sections AS (
  SELECT document_id, char_offset, level, text,
         CASE WHEN nth = 1 THEN base ELSE base || '-' || (nth - 1) END AS anchor
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY char_offset) AS nth
        FROM (SELECT *, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''),
                       'section-' || row_number() OVER (PARTITION BY document_id ORDER BY char_offset)) AS base
              FROM md_heads WHERE text <> ''))
)""".replace("%(ws)s", WS)


# --- conversations ------------------------------------------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    base = F.timestamp_add("HOUR", F.col("conv_id").cast("int"), F.lit(EPOCH).cast("timestamp"))
    return turns.select(
        "conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"),
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("New Conversation"))
        .otherwise(F.concat(F.lit("Talk: No. "), F.col("conv_id").cast("string"))).alias("title"),
        base.alias("created_at"),
        F.timestamp_add("MINUTE", F.col("last_turn").cast("int"), base).alias("updated_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns; a system turn is not a message."""
    base = F.timestamp_add("HOUR", F.col("conv_id").cast("int"), F.lit(EPOCH).cast("timestamp"))
    return load(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"),
        "role", F.col("text").alias("content"),
        F.timestamp_add("MINUTE", F.col("turn").cast("int"), base).alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feedback rows per message; some name another user or a user's own message."""
    n = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = messages(spark, sf_dir).select("*", n.alias("n"))
    owner = F.when(F.col("conv_id") % 5 == 4, F.lit("u9")).otherwise(
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string"))
    )
    return rows.select(
        F.concat("message_id", F.lit("-f"), F.col("n").cast("string")).alias("feedback_id"), "message_id",
        "conversation_id", owner.alias("user_id"),
        F.when(F.col("n") == 1, F.concat(F.lit("Use ```this``` instead:\n"), "content"))
        .otherwise(F.concat(F.lit("  no. "), F.col("turn").cast("string"), F.lit("  ")))
        .alias("suggested_correction"),
        F.timestamp_add("SECOND", F.col("n"), F.col("created_at")).alias("created_at"),
    )


CONVS = f"""
convs AS (
  SELECT conv_id, 'c' || conv_id AS conversation_id, 'u' || (conv_id % 7) AS user_id,
         CASE WHEN conv_id % 3 = 0 THEN 'New Conversation' ELSE 'Talk: No. ' || conv_id END AS title,
         TIMESTAMP '{EPOCH}' + to_hours(conv_id) AS created_at,
         TIMESTAMP '{EPOCH}' + to_hours(conv_id) + to_minutes(max(turn)) AS updated_at
  FROM conversations GROUP BY conv_id
),
msgs AS (
  SELECT conv_id, turn, 'c' || conv_id AS conversation_id, 'c' || conv_id || '-' || turn AS message_id,
         role, text AS content, TIMESTAMP '{EPOCH}' + to_hours(conv_id) + to_minutes(turn) AS created_at
  FROM conversations WHERE role IN ('user', 'assistant')
)"""

FEEDBACK = """
fb AS (
  SELECT message_id || '-f' || n AS feedback_id, message_id, conversation_id,
         CASE WHEN conv_id % 5 = 4 THEN 'u9' ELSE 'u' || (conv_id % 7) END AS user_id,
         CASE WHEN n = 1 THEN 'Use ```this``` instead:' || chr(10) || content ELSE '  no. ' || turn || '  ' END
           AS suggested_correction,
         created_at + to_seconds(n) AS created_at
  FROM msgs, (VALUES (1), (2)) AS t(n)
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages as raw model answers: markers after the text, some refusals."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda p: F.struct(p.alias("p"), _chunk_of(F.col("conv_id"), p).alias("id")))
    cited = F.filter(ids, lambda x: x["p"] % 6 == F.col("turn") % 6)
    marks = F.array_join(F.transform(cited, lambda x: F.concat(F.lit("[c:"), x["id"], F.lit("]"))), " and ")
    refusal = F.when(F.col("conv_id") % 10 == 0, F.lit(" I could not find this in the documentation.")).otherwise("")
    final = F.concat("content", F.lit(" "), marks, refusal)
    return messages(spark, sf_dir).where(F.col("role") == "assistant").select(
        "message_id", "conv_id", "turn", F.concat(F.lit("Looking it up. "), final).alias("answer"), final.alias("final_text")
    )


def _chunk_of(conv_id: Column, pos: Column) -> Column:
    return F.concat(
        F.lit("d"), ((conv_id + pos * pos) % 13).cast("string"), F.lit("-"), ((pos * 7) % 5).cast("string")
    )


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty retrieved chunks per answer, with repeats."""
    rows = answers(spark, sf_dir).select(
        "message_id", "conv_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("pos")
    )
    doc = F.concat(F.lit("d"), ((F.col("conv_id") + F.col("pos") * F.col("pos")) % 13).cast("string"))
    index = (F.col("pos") * 7) % 5
    return rows.select(
        "message_id", F.col("pos"), F.concat(doc, F.lit("-"), index.cast("string")).alias("chunk_id"),
        F.concat(F.lit("text of "), doc).alias("content"), doc.alias("document_id"),
        F.concat(F.lit("Title "), doc).alias("document_title"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(SITE), doc)).alias("document_url"),
        F.when(F.col("conv_id") % 4 == 1, F.concat(doc, F.lit(".md"))).alias("document_content_path"),
        F.lit("docs").alias("source_type"), F.array(F.lit("Guide"), doc).alias("section_path"),
        F.concat(F.lit("s-"), index.cast("string")).alias("anchor"), index.alias("chunk_index"),
    )


ANSWERS = """
answers AS (
  SELECT message_id, conv_id, turn, 'Looking it up. ' || final_text AS answer, final_text
  FROM (SELECT m.message_id, m.conv_id, m.turn,
               m.content || ' ' || coalesce(string_agg('[c:d' || ((m.conv_id + p * p) % 13) || '-' || ((p * 7) % 5) || ']', ' and ' ORDER BY p)
                            FILTER (p % 6 = m.turn % 6), '')
               || CASE WHEN m.conv_id % 10 = 0 THEN ' I could not find this in the documentation.' ELSE '' END AS final_text
        FROM msgs m, range(20) AS r(p) WHERE m.role = 'assistant' GROUP BY m.message_id, m.conv_id, m.turn, m.content)
),
retrieved AS (
  SELECT message_id, pos, document_id || '-' || chunk_index AS chunk_id, document_id, chunk_index, conv_id
  FROM (SELECT message_id, conv_id, CAST(p AS INTEGER) AS pos, 'd' || ((conv_id + p * p) % 13) AS document_id,
               CAST((p * 7) % 5 AS INTEGER) AS chunk_index FROM answers, range(20) AS r(p))
)"""


# --- fetch log ----------------------------------------------------------------------


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one fetch run with mixed content types and results."""
    n = F.col("page_id")
    return load(spark, sf_dir, "pages").select(
        n.alias("page_id"),
        F.when(n % 17 == 5, F.concat(F.lit("ftp://"), F.substring(F.col("url"), F.lit(8), F.length("url")))).otherwise(F.col("url")).alias("url"),
        F.when(~(n % 10).isin(3, 7, 9), F.when(n % 23 == 11, F.lit("").cast("binary")).otherwise(F.col("html").cast("binary"))).alias("content"),
        F.when(n % 4 == 0, F.lit("text/html; charset=utf-8")).when(n % 4 == 2, F.lit(" TEXT/HTML "))
        .when(n % 4 == 3, F.lit("application/xhtml+xml")).alias("content_type"),
        F.when(n % 2 == 0, F.concat(F.lit("etag-"), n.cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(n % 10 == 3, 304).when(n % 10 == 7, 404).when(n % 10 == 9, 500).otherwise(200).alias("http_status"),
        F.when(n % 29 == 13, F.lit("read timed out")).alias("fetch_error"),
        (n % 31 != 6).alias("robots_allowed"),
    )


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table before the run: four of five pages, every third with an old hash."""
    n = F.col("page_id")
    stamp = F.lit(EPOCH).cast("timestamp")
    return load(spark, sf_dir, "pages").where(n % 5 != 0).select(
        F.concat(F.lit("p"), n.cast("string")).alias("document_id"), F.concat(F.lit("Old title "), n.cast("string")).alias("title"),
        F.lit("kept").alias("description"), "url", F.lit(None).cast("string").alias("content_path"),
        F.lit("docs").alias("source_type"), F.lit("xx").alias("lang"),
        F.concat(F.lit("old-"), n.cast("string")).alias("etag"), F.lit("long ago").alias("last_modified"),
        F.when(n % 3 == 0, F.lit("stale")).otherwise(F.sha2(F.col("html").cast("binary"), 256)).alias("content_hash"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        stamp.alias("last_crawled_at"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


FETCH = f"""
flog AS (
  SELECT page_id, CASE WHEN page_id % 17 = 5 THEN 'ftp://' || substr(url, 8) ELSE url END AS url,
         CASE WHEN page_id % 10 IN (3, 7, 9) THEN NULL WHEN page_id % 23 = 11 THEN '' ELSE html END AS content,
         CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 2 THEN ' TEXT/HTML ' WHEN 3 THEN 'application/xhtml+xml' END AS content_type,
         CASE WHEN page_id % 2 = 0 THEN 'etag-' || page_id END AS etag,
         CASE page_id % 10 WHEN 3 THEN 304 WHEN 7 THEN 404 WHEN 9 THEN 500 ELSE 200 END AS http_status,
         CASE WHEN page_id % 29 = 13 THEN 'read timed out' END AS fetch_error,
         page_id % 31 <> 6 AS robots_allowed
  FROM pages
),
stored AS (
  SELECT 'p' || page_id AS document_id, 'Old title ' || page_id AS title, url,
         'old-' || page_id AS etag, CASE WHEN page_id % 3 = 0 THEN 'stale' ELSE sha256(html) END AS content_hash
  FROM pages WHERE page_id % 5 <> 0
),
classified AS (
  SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'error'
                 WHEN NOT robots_allowed THEN 'skipped_robots'
                 WHEN fetch_error IS NOT NULL OR http_status >= 400 THEN 'error'
                 WHEN http_status = 304 THEN 'not_modified' ELSE 'ok' END AS status,
         CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid_scheme'
              WHEN NOT robots_allowed THEN NULL
              WHEN fetch_error IS NOT NULL THEN fetch_error
              WHEN http_status >= 400 THEN 'HTTP ' || http_status END AS error
  FROM flog
),
outcomes AS (
  SELECT *, CASE WHEN error_message IS NOT NULL THEN 'error'
                 WHEN status = 'not_modified' OR same THEN 'unchanged'
                 WHEN old_id IS NOT NULL THEN 'updated' ELSE 'ingested' END AS outcome
  FROM (SELECT *, CASE WHEN status = 'skipped_robots' THEN 'skipped by robots.txt'
                       WHEN status = 'not_modified' THEN NULL
                       WHEN status = 'error' THEN 'fetch failed: ' || error
                       WHEN content IS NULL THEN 'crawler returned OK with empty body'
                       WHEN content = '' THEN 'extractor yielded no body (possibly JS-rendered or empty page)' END AS error_message
        FROM (SELECT c.*, s.document_id AS old_id, s.title AS old_title, s.etag AS old_etag, s.content_hash AS old_hash,
                     coalesce(s.content_hash = sha256(c.content), FALSE) AS same,
                     sha256(c.content) AS new_hash,
                     nullif(trim(regexp_replace(regexp_extract(c.content, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS page_title,
                     nullif(regexp_extract(c.content, '(?is)<html[^>]*\\slang="([^"]*)"', 1), '') AS page_lang
              FROM classified c LEFT JOIN stored s ON c.url = s.url))
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
