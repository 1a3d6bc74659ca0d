"""Queries over documents: chunks, sections, pages, catalog, library, migration."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions.sections import breadcrumbs, parse_sections, section_title
from ..functions.text import (
    HTML_STEPS, decode_html, detect_format, html_title, html_to_markdown, shorten, slugify,
    token_count, truncate_tokens,
)
from ..operators import catalog as cat
from ..operators import context, ingest
from ..operators.chunking import chunk_documents, request_batches
from ..sources import legacy
from ..sources.url_list import TRAILING, urls_in_lines
from ..sources.vault import parse_notes
from . import tables as T
from .registry import query


# --- chunks and sections -------------------------------------------------------------


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
SELECT chunk_id, document_id, chunk_index, content FROM chunks""")
def line_chunks(spark, sf_dir):
    return T.doc_chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_index", "content")


@query(T.with_ctes(T.DOCS, T.MARKED) + """
SELECT document_id, level, text, CAST(char_offset AS INTEGER) AS char_offset, anchor FROM md_sections""", ints=("level",))
def sections(spark, sf_dir):
    docs = T.markdown_documents(spark, sf_dir)
    return docs.select("document_id", F.explode(parse_sections("body")).alias("s")).select("document_id", "s.*")


@query(T.with_ctes(T.DOCS, T.MARKED) + """
SELECT document_id, anchor, count(*) AS n_sections, min(level) AS top_level
FROM md_sections GROUP BY document_id, anchor""", ints=("top_level",))
def section_anchors(spark, sf_dir):
    docs = T.markdown_documents(spark, sf_dir)
    secs = docs.select("document_id", F.explode(parse_sections("body")).alias("s")).select("document_id", "s.*")
    return secs.groupBy("document_id", "anchor").agg(
        F.count(F.lit(1)).alias("n_sections"), F.min("level").alias("top_level")
    )


@query(T.with_ctes(T.DOCS, T.MARKED) + f"""
SELECT d.document_id,
       coalesce(arg_min(s.text, s.char_offset) FILTER (s.level = 1), arg_min(s.text, s.char_offset), d.url) AS title,
       trim(regexp_replace(lower(coalesce(arg_min(s.text, s.char_offset) FILTER (s.level = 1), arg_min(s.text, s.char_offset), d.url)),
            '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM docs d LEFT JOIN md_sections s USING (document_id) GROUP BY d.document_id, d.url""")
def doc_titles(spark, sf_dir):
    docs = T.markdown_documents(spark, sf_dir)
    return docs.select("document_id", F.coalesce(section_title(parse_sections("body")), "url").alias("title")).select(
        "document_id", "title", slugify("title").alias("slug")
    )


@query(T.with_ctes(T.DOCS, T.MARKED) + """
, tops AS (
  SELECT *, max(CASE WHEN level = 1 THEN char_offset END) OVER w AS o1 FROM md_sections
  WINDOW w AS (PARTITION BY document_id ORDER BY char_offset)
), seconds AS (
  SELECT *, max(CASE WHEN level = 2 THEN char_offset END) OVER w AS o2 FROM tops
  WINDOW w AS (PARTITION BY document_id, coalesce(o1, -1) ORDER BY char_offset)
)
SELECT s.document_id, CAST(s.char_offset AS INTEGER) AS char_offset, s.level,
       concat_ws(' › ', CASE WHEN s.level > 1 THEN a.text END, CASE WHEN s.level > 2 THEN b.text END, s.text) AS breadcrumb
FROM seconds s
LEFT JOIN md_sections a ON a.document_id = s.document_id AND a.char_offset = s.o1
LEFT JOIN md_sections b ON b.document_id = s.document_id AND b.char_offset = s.o2""", ints=("level",))
def chunk_breadcrumbs(spark, sf_dir):
    docs = T.markdown_documents(spark, sf_dir).select("document_id", parse_sections("body").alias("secs"))
    zipped = docs.select(
        "document_id", F.explode(F.arrays_zip(F.col("secs").alias("s"), breadcrumbs(F.col("secs")).alias("path"))).alias("z")
    )
    return zipped.select(
        "document_id", F.col("z.s.char_offset").alias("char_offset"), F.col("z.s.level").alias("level"),
        F.array_join("z.path", " › ").alias("breadcrumb"),
    )


@query(T.with_ctes(T.DOCS, T.MARKED) + """
, last_anchor AS (SELECT document_id, text, arg_max(anchor, char_offset) AS anchor FROM md_sections GROUP BY document_id, text)
SELECT s.document_id, CAST(s.char_offset AS INTEGER) AS char_offset, l.anchor
FROM md_sections s JOIN last_anchor l USING (document_id, text)""")
def chunk_anchor_join(spark, sf_dir):
    from ..functions.sections import anchor_for

    docs = T.markdown_documents(spark, sf_dir).select("document_id", parse_sections("body").alias("secs"))
    return docs.select(
        "document_id",
        F.explode(F.transform(
            "secs", lambda s: F.struct(s["char_offset"].alias("char_offset"), anchor_for(s["text"], F.col("secs")).alias("anchor"))
        )).alias("z"),
    ).select("document_id", "z.char_offset", "z.anchor")


TOKENS_SQL = "'[\\p{L}\\p{N}_]{1,16}|[^\\p{L}\\p{N}_\\s]'"
SPACED_SQL = "'\\s*(?:[\\p{L}\\p{N}_]{1,16}|[^\\p{L}\\p{N}_\\s])'"

# Packing is a recursion over the pieces of a section, all sections in step; locating
# is one over the chunks of a document.
PACKED = f"""
ck_lines AS (
  SELECT document_id, i, rl, bare, starts_with(rl, '#') AND (document_id, bare) IN (SELECT document_id, text FROM md_sections) AS is_head
  FROM (SELECT document_id, i, rtrim(line, {T.WS}) AS rl, trim(ltrim(rtrim(line, {T.WS}), '# '), {T.WS}) AS bare FROM md_lines)
),
ck_numbered AS (
  SELECT *, sum(CAST(is_head AS INTEGER)) OVER w AS head_no, sum(CAST(rl = '' AS INTEGER)) OVER w AS blank_no,
         CASE WHEN is_head THEN least(6, length(regexp_extract(rl, '^#+'))) END AS level
  FROM ck_lines WINDOW w AS (PARTITION BY document_id ORDER BY i)
),
ck_paras AS (
  SELECT document_id, head_no, blank_no, trim(string_agg(rl, chr(10) ORDER BY i), {T.WS}) AS text
  FROM ck_numbered WHERE NOT is_head AND rl <> '' GROUP BY document_id, head_no, blank_no
),
ck_h1 AS (SELECT *, max(CASE WHEN level = 1 THEN head_no END) OVER (PARTITION BY document_id ORDER BY head_no) AS n1 FROM ck_numbered WHERE is_head),
ck_h2 AS (SELECT *, max(CASE WHEN level = 2 THEN head_no END) OVER (PARTITION BY document_id, coalesce(n1, -1) ORDER BY head_no) AS n2 FROM ck_h1),
ck_paths AS (
  SELECT h.document_id, h.head_no, h.bare AS heading,
         list_filter([CASE WHEN h.level > 1 THEN a.bare END, CASE WHEN h.level > 2 THEN b.bare END, h.bare], lambda x: x IS NOT NULL) AS path
  FROM ck_h2 h LEFT JOIN ck_h1 a ON a.document_id = h.document_id AND a.head_no = h.n1
  LEFT JOIN ck_h1 b ON b.document_id = h.document_id AND b.head_no = h.n2
),
ck_used AS (
  SELECT *, CASE WHEN n > 256 THEN 0 ELSE n END AS used
  FROM (SELECT *, len(regexp_extract_all(array_to_string(path, chr(10)), {TOKENS_SQL})) AS n FROM ck_paths)
),
ck_sized AS (
  SELECT p.*, coalesce(u.used, 0) AS used, 512 - coalesce(u.used, 0) AS budget, u.path, u.heading,
         regexp_extract_all(p.text, {SPACED_SQL}) AS toks
  FROM ck_paras p LEFT JOIN ck_used u ON u.document_id = p.document_id AND u.head_no = p.head_no
),
ck_cut AS (SELECT *, unnest(range((greatest(len(toks), 1) - 1) // budget + 1)) AS piece FROM ck_sized),
ck_pieces AS (
  SELECT document_id, head_no, used, budget, path, heading,
         CASE WHEN len(toks) <= budget THEN text ELSE trim(array_to_string(toks[piece * budget + 1:(piece + 1) * budget], ''), {T.WS}) END AS text,
         least(budget, len(toks) - piece * budget) AS n,
         row_number() OVER (PARTITION BY document_id, head_no ORDER BY blank_no, piece) AS r
  FROM ck_cut
),
ck_packed AS (
  SELECT document_id, head_no, r, 0 AS chunk_no, n AS total FROM ck_pieces WHERE r = 1
  UNION ALL
  SELECT p.document_id, p.head_no, p.r, CASE WHEN k.total + p.n <= p.budget THEN k.chunk_no ELSE k.chunk_no + 1 END,
         CASE WHEN k.total + p.n <= p.budget THEN k.total + p.n ELSE p.n END
  FROM ck_packed k JOIN ck_pieces p ON p.document_id = k.document_id AND p.head_no = k.head_no AND p.r = k.r + 1
),
ck_chunks AS (
  SELECT p.document_id, CAST(row_number() OVER (PARTITION BY p.document_id ORDER BY p.head_no, k.chunk_no) - 1 AS INTEGER) AS chunk_index,
         any_value(p.heading) AS heading, coalesce(array_to_string(any_value(p.path), ' › '), '') AS breadcrumb,
         CASE WHEN any_value(p.used) > 0 THEN array_to_string(any_value(p.path), chr(10)) || chr(10) ELSE '' END
           || string_agg(p.text, chr(10) ORDER BY p.r) AS content
  FROM ck_packed k JOIN ck_pieces p ON p.document_id = k.document_id AND p.head_no = k.head_no AND p.r = k.r
  GROUP BY p.document_id, p.head_no, k.chunk_no
)"""

LOCATED = f"""
bodies AS (SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS body FROM md_lines GROUP BY document_id),
probes AS (
  SELECT c.document_id, c.chunk_index, c.content, length(c.content) AS n, b.body,
         list_filter(string_split(c.content, chr(10)), lambda x: trim(x, {T.WS}) <> '')[1] AS probe,
         strpos(b.body, c.content) AS anywhere
  FROM ck_chunks c JOIN bodies b ON b.document_id = c.document_id
),
located AS (
  SELECT document_id, chunk_index, char_start, char_end FROM (
    SELECT *, CASE WHEN anywhere > 0 THEN anywhere - 1 WHEN length(probe) >= 12 AND strpos(body, probe) > 0 THEN strpos(body, probe) - 1 ELSE 0 END AS char_start,
           CASE WHEN anywhere > 0 OR (length(probe) >= 12 AND strpos(body, probe) > 0)
             THEN CASE WHEN anywhere > 0 THEN anywhere - 1 ELSE strpos(body, probe) - 1 END + n ELSE least(n, length(body)) END AS char_end
    FROM probes WHERE chunk_index = 0)
  UNION ALL
  SELECT document_id, chunk_index, coalesce(hit, cur), CASE WHEN hit IS NULL THEN least(cur + n, size) ELSE hit + n END FROM (
    SELECT p.document_id, p.chunk_index, l.char_end AS cur, p.n, length(p.body) AS size,
           CASE WHEN strpos(substr(p.body, l.char_end + 1), p.content) > 0 THEN l.char_end + strpos(substr(p.body, l.char_end + 1), p.content) - 1
                WHEN p.anywhere > 0 THEN p.anywhere - 1
                WHEN length(p.probe) >= 12 AND strpos(substr(p.body, l.char_end + 1), p.probe) > 0
                  THEN l.char_end + strpos(substr(p.body, l.char_end + 1), p.probe) - 1 END AS hit
    FROM located l JOIN probes p ON p.document_id = l.document_id AND p.chunk_index = l.chunk_index + 1)
)"""


@query(T.with_ctes("RECURSIVE " + T.DOCS.strip(), T.MARKED, PACKED) + """
, last_anchor AS (SELECT document_id, text, arg_max(anchor, char_offset) AS anchor FROM md_sections GROUP BY document_id, text)
SELECT c.document_id || '-' || chunk_index AS chunk_id, c.document_id, chunk_index, content, breadcrumb, a.anchor
FROM ck_chunks c LEFT JOIN last_anchor a ON a.document_id = c.document_id AND a.text = c.heading""")
def token_chunks(spark, sf_dir):
    return chunk_documents(T.markdown_documents(spark, sf_dir)).select(
        "chunk_id", "document_id", "chunk_index", "content", F.array_join("section_path", " › ").alias("breadcrumb"), "anchor"
    )


@query(T.with_ctes("RECURSIVE " + T.DOCS.strip(), T.MARKED, PACKED, LOCATED) + """
SELECT document_id || '-' || chunk_index AS chunk_id, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM located""")
def chunk_offsets(spark, sf_dir):
    return chunk_documents(T.markdown_documents(spark, sf_dir)).select("chunk_id", "char_start", "char_end")


@query(T.with_ctes(T.DOCS) + f"""
SELECT document_id, len(regexp_extract_all(body, {TOKENS_SQL})) AS n_tokens,
       CASE WHEN len(regexp_extract_all(body, {TOKENS_SQL})) <= 300 THEN body
            ELSE array_to_string(regexp_extract_all(body, '\\s*(?:[\\p{{L}}\\p{{N}}_]{{1,16}}|[^\\p{{L}}\\p{{N}}_\\s])')[1:300], '') END AS head
FROM docs""")
def token_counts(spark, sf_dir):
    return T.documents(spark, sf_dir).select(
        "document_id", token_count("body").cast("bigint").alias("n_tokens"), truncate_tokens("body", 300).alias("head")
    )


BATCH_ITEMS, BATCH_TOKENS = 16, 1500


@query(T.with_ctes("RECURSIVE " + T.DOCS.strip(), T.CHUNKS) + f"""
, sized AS (
  SELECT document_id, chunk_index, least(len(regexp_extract_all(content, {TOKENS_SQL})), 400) AS tokens FROM chunks
), packed AS (
  SELECT document_id, chunk_index, tokens, 0 AS batch_id, 1 AS n, tokens AS total FROM sized WHERE chunk_index = 0
  UNION ALL
  SELECT s.document_id, s.chunk_index, s.tokens,
         CASE WHEN p.total + s.tokens > {BATCH_TOKENS} OR p.n >= {BATCH_ITEMS} THEN p.batch_id + 1 ELSE p.batch_id END,
         CASE WHEN p.total + s.tokens > {BATCH_TOKENS} OR p.n >= {BATCH_ITEMS} THEN 1 ELSE p.n + 1 END,
         CASE WHEN p.total + s.tokens > {BATCH_TOKENS} OR p.n >= {BATCH_ITEMS} THEN s.tokens ELSE p.total + s.tokens END
  FROM packed p JOIN sized s ON s.document_id = p.document_id AND s.chunk_index = p.chunk_index + 1
)
SELECT document_id, chunk_index, batch_id, CAST(tokens AS INTEGER) AS tokens FROM packed""")
def request_packing(spark, sf_dir):
    items = T.documents(spark, sf_dir).select(
        "document_id",
        F.filter(F.transform(F.split("body", "\n"), _strip), lambda line: line != "").alias("content"),
    )
    return request_batches(
        items, "document_id", "chunk_index", max_items=BATCH_ITEMS, max_tokens=BATCH_TOKENS, max_item_tokens=400
    ).select("document_id", "chunk_index", "batch_id", "tokens")


def _strip(c):
    from ..functions.text import strip

    return strip(c)


# --- pages ---------------------------------------------------------------------------


@query(T.with_ctes(T.FETCH).replace("WHEN page_id % 10 IN (3, 7, 9) THEN NULL WHEN page_id % 23 = 11 THEN ''", "WHEN FALSE THEN NULL") + """
SELECT page_id, CASE WHEN lower(trim(split_part(content_type, ';', 1))) IN ('application/pdf', 'application/x-pdf') THEN 'pdf'
            WHEN lower(trim(split_part(content_type, ';', 1))) IN ('text/markdown', 'text/x-markdown') THEN 'markdown'
            WHEN lower(trim(split_part(content_type, ';', 1))) IN ('text/html', 'application/xhtml+xml') THEN 'html'
            WHEN starts_with(content, '%PDF-') THEN 'pdf'
            WHEN regexp_matches(content, '^\\s*<') THEN 'html' ELSE 'markdown' END AS format
FROM flog""")
def page_format(spark, sf_dir):
    """All pages, with content types that decide and ones that don't."""
    types = T.fetch_log(spark, sf_dir).select("page_id", "content_type")
    pages = T.load(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return pages.join(types, "page_id").select("page_id", detect_format("content", "content_type").alias("format"))


@query(T.with_ctes(T.FETCH) + "SELECT page_id, status, error FROM classified")
def page_fetch_status(spark, sf_dir):
    return ingest.classify_fetch(T.fetch_log(spark, sf_dir)).select("page_id", "status", "error")


@query("""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title
FROM pages""")
def page_titles(spark, sf_dir):
    return T.load(spark, sf_dir, "pages").select("page_id", html_title("html").alias("title"))


def _markdown_sql(column: str) -> str:
    out = column
    for pattern, replacement in HTML_STEPS:
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    named = [(f"&{name};", chr(code)) for name, code in name2codepoint.items() if name not in ("nbsp", "amp")]
    # the ampersand goes last, so nothing is decoded twice
    for entity, raw in (*named, ("&nbsp;", " "), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{raw}')"
    return f"trim({out}, {T.WS})"


@query(f"SELECT page_id, {_markdown_sql('html')} AS markdown FROM pages")
def page_markdown(spark, sf_dir):
    return T.load(spark, sf_dir, "pages").select(
        "page_id", html_to_markdown(decode_html(F.col("html").cast("binary"))).alias("markdown")
    )


# --- catalog -------------------------------------------------------------------------


@query(T.with_ctes(T.DOCS) + """
SELECT document_id, title, description, url, source_type, lang, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM docs""")
def catalog(spark, sf_dir):
    return cat.catalog(T.documents(spark, sf_dir)).drop("content_path").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    )


@query(T.with_ctes(T.DOCS) + """
SELECT row_number() OVER (ORDER BY doc_no DESC) AS n,
       row_number() OVER (ORDER BY doc_no DESC) || '. ' || coalesce(nullif(title, ''), 'Untitled') || ' (id=' || document_id || ') — ' || url AS line
FROM docs""")
def catalog_block(spark, sf_dir):
    return cat.catalog_lines(T.documents(spark, sf_dir), "doc_no")


@query(T.with_ctes(T.DOCS) + """
SELECT row_number() OVER (ORDER BY doc_no DESC) AS n,
       row_number() OVER (ORDER BY doc_no DESC) || '. ' || coalesce(nullif(title, ''), 'Untitled') || ' (id=' || document_id || ') — ' || url AS line
FROM docs WHERE source_type IN ('src0', 'src3', 'src7')""")
def catalog_block_allowed(spark, sf_dir):
    return cat.catalog_lines(T.documents(spark, sf_dir), "doc_no", allowed=["src0", "src3", "src7"])


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
SELECT d.document_id, d.title, d.url, coalesce(c.n, 0) AS chunk_count FROM docs d
LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) c USING (document_id)""")
def documents_with_counts(spark, sf_dir):
    return cat.documents_with_counts(T.documents(spark, sf_dir), T.doc_chunks(spark, sf_dir)).select(
        "document_id", "title", "url", "chunk_count"
    )


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
, newest AS (SELECT * FROM docs WHERE title ILIKE '%the%re%' OR description ILIKE '%the%re%' OR url ILIKE '%the%re%'
             ORDER BY created_at DESC, document_id LIMIT 20)
SELECT d.document_id, d.title, coalesce(c.n, 0) AS chunk_count FROM newest d
LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) c USING (document_id)""")
def document_search(spark, sf_dir):
    return cat.search_documents(T.documents(spark, sf_dir), T.doc_chunks(spark, sf_dir), "the%re").select(
        "document_id", "title", "chunk_count"
    )


@query(T.with_ctes(T.DOCS) + """
SELECT document_id, url FROM docs
WHERE contains(lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(url, ''))), 'the')""")
def document_contains(spark, sf_dir):
    return cat.filter_documents(T.documents(spark, sf_dir), " The ").select("document_id", "url")


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
SELECT 'documents' AS kind, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks
UNION ALL SELECT 'vectors', count(*) FROM embeddings""")
def corpus_counts(spark, sf_dir):
    return cat.corpus_counts(
        T.documents(spark, sf_dir), T.doc_chunks(spark, sf_dir), T.load(spark, sf_dir, "embeddings")
    )


@query(T.with_ctes(T.DOCS) + """
SELECT document_id, CASE WHEN length(description) > 140 THEN substr(description, 1, 137) || '…' ELSE description END AS short
FROM docs""")
def description_previews(spark, sf_dir):
    return T.documents(spark, sf_dir).select("document_id", shorten("description", 140, 137).alias("short"))


# --- library reads -----------------------------------------------------------------------


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
, asked AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels),
library AS (SELECT document_id FROM docs WHERE source_type <> 'src5')
SELECT c.document_id, c.chunk_index, c.content FROM chunks c
WHERE c.document_id IN (SELECT document_id FROM asked) AND c.document_id IN (SELECT document_id FROM library)""")
def readable_documents(spark, sf_dir):
    asked = T.load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    library = T.documents(spark, sf_dir).where("source_type <> 'src5'").select("document_id")
    return context.readable_chunks(asked, library, T.doc_chunks(spark, sf_dir)).select(
        "document_id", "chunk_index", "content"
    ).orderBy("document_id", "chunk_index")


RENDER_CHARS = 2000


@query(T.with_ctes(T.DOCS, T.CHUNKS) + f"""
, asked AS (SELECT DISTINCT CAST(item_id * 7 AS VARCHAR) AS document_id FROM benchmark UNION
            SELECT document_id FROM docs UNION SELECT 'none-' || label FROM embeddings),
state AS (
  SELECT a.document_id, d.title, CASE WHEN d.source_type = 'src5' OR d.document_id IS NULL
    THEN 'document_id ''' || a.document_id || ''' is not in the current library. Only ids from prior search results are valid.' END AS error
  FROM asked a LEFT JOIN docs d USING (document_id)
),
crumbs AS (
  SELECT c.*, 'Part ' || (chunk_index // 3) AS crumb FROM chunks c
),
pieces AS (
  SELECT c.document_id, s.title, c.chunk_index,
         '[c:' || chunk_id || '] ' || CASE WHEN lag(crumb) OVER (PARTITION BY c.document_id ORDER BY chunk_index) IS DISTINCT FROM crumb
           THEN crumb || chr(10) || chr(10) ELSE '' END || content AS piece
  FROM crumbs c JOIN state s ON s.document_id = c.document_id AND s.error IS NULL
),
sized AS (
  SELECT *, length('# ' || title || chr(10)) + sum(length(piece) + 2) OVER (PARTITION BY document_id ORDER BY chunk_index) AS used FROM pieces
),
texts AS (
  SELECT document_id, string_agg(piece, chr(10) || chr(10) ORDER BY chunk_index) FILTER (used <= {RENDER_CHARS}) AS body,
         count(*) FILTER (used <= {RENDER_CHARS}) AS kept, count(*) FILTER (used > {RENDER_CHARS}) AS dropped
  FROM sized GROUP BY document_id
)
SELECT s.document_id, s.error IS NULL AS ok, s.error,
       CASE WHEN s.error IS NULL THEN '# ' || s.title || chr(10) || coalesce(chr(10) || chr(10) || t.body, '') ||
         CASE WHEN t.dropped > 0 THEN chr(10) || chr(10) || chr(10) || '[document truncated — ' || t.dropped ||
           ' more chunks omitted to stay within the {RENDER_CHARS}-character cap for tool responses]' ELSE '' END END AS text,
       coalesce(t.kept, 0) AS kept_chunks, coalesce(t.dropped, 0) AS dropped_chunks
FROM state s LEFT JOIN texts t USING (document_id)""")
def rendered_documents(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    asked = (
        T.load(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).cast("string").alias("document_id"))
        .unionByName(docs.select("document_id"))
        .unionByName(T.load(spark, sf_dir, "embeddings").select(F.concat(F.lit("none-"), F.col("label").cast("string")).alias("document_id")))
    )
    chunks = T.doc_chunks(spark, sf_dir).withColumn(
        "section_path", F.array(F.concat(F.lit("Part "), F.floor(F.col("chunk_index") / 3).cast("string")))
    )
    return context.render_documents(
        asked, docs, chunks, max_chars=RENDER_CHARS, allowed_ids=docs.where("source_type <> 'src5'")
    )


# --- lists and trees -------------------------------------------------------------------------


@query(f"""
WITH lines AS (
  SELECT page_id * 2 + k AS line_no,
         CASE WHEN k = 1 THEN '# skipped ' || url WHEN page_id % 3 = 0 THEN '- see [page](' || url || '), and ' || url || '.'
              WHEN page_id % 3 = 1 THEN '   ' || url || '   ' ELSE 'twice "' || url || '" https://docs.example.com/' || (page_id % 11) || ';' END AS line
  FROM pages, (VALUES (0), (1)) AS t(k)
),
raw AS (SELECT line_no, unnest(us) AS u, unnest(range(len(us))) AS pos
        FROM (SELECT line_no, regexp_extract_all(line, 'https?://\\S+') AS us FROM lines
              WHERE NOT starts_with(trim(line), '#') AND trim(line) <> '')),
urls AS (SELECT rtrim(u, '{TRAILING.replace("'", "''")}') AS url, line_no, pos FROM raw)
SELECT url, arg_min(line_no, line_no * 1000 + pos) AS line_no, CAST(arg_min(pos, line_no * 1000 + pos) AS INTEGER) AS pos FROM urls GROUP BY url""")
def url_list(spark, sf_dir):
    n, url = F.col("page_id"), F.col("url")
    line = (
        F.when(F.col("k") == 1, F.concat(F.lit("# skipped "), url))
        .when(n % 3 == 0, F.concat(F.lit("- see [page]("), url, F.lit("), and "), url, F.lit(".")))
        .when(n % 3 == 1, F.concat(F.lit("   "), url, F.lit("   ")))
        .otherwise(F.concat(F.lit('twice "'), url, F.lit('" https://docs.example.com/'), (n % 11).cast("string"), F.lit(";")))
    )
    lines = T.load(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        (n * 2 + F.col("k")).alias("line_no"), line.alias("line")
    )
    return urls_in_lines(lines, ["line_no"])


def _notes(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    head = F.concat(
        F.lit('---\ntitle: "Note '), "document_id", F.lit('"\nlang: '), "lang", F.lit("\nsource: https://docs.example.com/n/"),
        (F.col("doc_no") % 211).cast("string"), F.lit("\ntags:\n  - a\n---\n\n"),
    )
    text = F.concat(F.when(F.col("doc_no") % 4 == 0, F.lit("")).otherwise(head), F.when(F.col("doc_no") % 50 == 7, F.lit("  \n")).otherwise(F.col("body")))
    path = F.concat(F.lit("notes/"), "source_type", F.lit("/n"), F.lpad("document_id", 9, "0"), F.lit(".md"))
    return docs.select("doc_no", path.alias("content_path"), text.cast("binary").alias("content"))


NOTES = f"""
notes AS (
  SELECT doc_no, 'notes/' || source_type || '/n' || lpad(document_id, 9, '0') || '.md' AS content_path, lang,
         doc_no % 4 <> 0 AS has_head, CASE WHEN doc_no % 50 = 7 THEN '' ELSE trim(body, {T.WS}) END AS body,
         'https://docs.example.com/n/' || (doc_no % 211) AS url
  FROM docs
)"""


@query(T.with_ctes(T.DOCS, NOTES) + """
SELECT content_path, CASE WHEN has_head THEN 'Note ' || doc_no END AS title, CASE WHEN has_head THEN lang END AS lang,
       CASE WHEN has_head THEN url END AS source, body FROM notes""")
def frontmatter(spark, sf_dir):
    notes = parse_notes(_notes(spark, sf_dir))

    def meta(k):
        return F.try_element_at("metadata", F.lit(k)).alias(k)

    return notes.select("content_path", meta("title"), meta("lang"), meta("source"), "body")


@query(T.with_ctes(T.DOCS, NOTES) + """
, fresh AS (SELECT * FROM notes WHERE body <> '' AND doc_no % 5 <> 1),
winners AS (SELECT url, min(content_path) AS winner FROM fresh WHERE has_head GROUP BY url)
SELECT n.content_path,
       CASE WHEN n.doc_no % 5 = 1 AND n.doc_no % 3 = 0 THEN 'unchanged' WHEN n.body = '' THEN 'error'
            WHEN n.doc_no % 5 = 1 THEN 'updated'
            WHEN n.has_head AND w.winner < n.content_path THEN 'error' ELSE 'ingested' END AS outcome,
       CASE WHEN n.doc_no % 5 = 1 AND n.doc_no % 3 = 0 THEN NULL WHEN n.body = '' THEN 'empty body'
            WHEN n.doc_no % 5 <> 1 AND n.has_head AND w.winner < n.content_path THEN 'duplicate url' END AS error_message
FROM notes n LEFT JOIN winners w ON w.url = n.url""")
def markdown_vault(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    stored = notes.where("doc_no % 5 = 1").select(
        F.concat(F.lit("v"), F.col("doc_no").cast("string")).alias("document_id"), "content_path",
        F.lit(None).cast("string").alias("url"),
        F.when(F.col("doc_no") % 3 == 0, F.sha2("content", 256)).otherwise(F.lit("old")).alias("content_hash"),
    )
    return ingest.stage_vault(parse_notes(notes), stored, "docs").select("content_path", "outcome", "error_message")


# --- migration ---------------------------------------------------------------------------------


@query(T.with_ctes(T.DOCS) + """
SELECT e.vec_id || '-0' AS chunk_id, CAST(e.vec_id AS VARCHAR) AS document_id, 'Vector ' || e.vec_id AS content, e.label AS chunk_index,
       'Label, "' || e.label || '"' AS breadcrumb, coalesce(d.title, '') AS document_title, d.url AS document_url,
       CASE WHEN e.label % 2 = 0 THEN 'docs' ELSE 'vault' END AS source_type, len(e.embedding) AS dim,
       round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value
FROM embeddings e LEFT JOIN (SELECT * FROM docs WHERE doc_no % 3 <> 0) d ON d.document_id = CAST(e.vec_id AS VARCHAR)""")
def migrated_chunks(spark, sf_dir):
    old = T.load(spark, sf_dir, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit("-0")).alias("chunk_id"), F.col("vec_id").alias("document_id"),
        F.concat(F.lit("Vector "), F.col("vec_id").cast("string")).alias("content"),
        F.to_json("embedding").alias("embedding"), F.col("label").alias("chunk_index"),
        F.to_json(F.array(F.concat(F.lit('Label, "'), F.col("label").cast("string"), F.lit('"')))).alias("section_path"),
        F.when(F.col("label") % 2 == 0, F.lit("")).otherwise(F.lit("vault")).alias("source_type"),
    )
    docs = T.documents(spark, sf_dir).where("doc_no % 3 <> 0")
    rows = legacy.index_rows(legacy.legacy_chunks(old), docs)
    return rows.select(
        "chunk_id", "document_id", "content", "chunk_index", F.array_join("section_path", " › ").alias("breadcrumb"),
        "document_title", "document_url", "source_type", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
    )


def _old_store(spark, sf_dir):
    docs = T.documents(spark, sf_dir)
    kept = docs.where("doc_no % 3 <> 1").withColumn("metadata", F.create_map().cast("map<string,string>"))
    stored = legacy.legacy_documents(kept.withColumn("title", F.lit("stored")))
    chunks = T.doc_chunks(spark, sf_dir)
    now = chunks.where("chunk_index % 2 = 0").withColumn("content", F.lit("stored"))
    names = ("chunk_id", "document_id", "content", "chunk_index", "section_path", "anchor", "char_start", "char_end", "source_type")
    old = chunks.withColumn("embedding", F.when(F.col("chunk_index") == 0, F.lit("[1.0, 2.0]")))
    return docs.drop("body", "doc_no"), old, stored, now.select(*names)


@query(T.with_ctes(T.DOCS, T.CHUNKS) + """
SELECT 'documents_inserted' AS kind, count(*) AS n FROM docs WHERE doc_no % 3 = 1
UNION ALL SELECT 'chunks_written', count(*) FROM chunks
UNION ALL SELECT 'vectors_written', count(*) FROM chunks WHERE chunk_index = 0""")
def migration_counts(spark, sf_dir):
    old_docs, old_chunks, stored, now = _old_store(spark, sf_dir)
    return legacy.migrate(stored, now, old_docs, old_chunks, dry_run=True)[2]


@query(T.with_ctes(T.DOCS) + """
SELECT document_id, CASE WHEN doc_no % 3 <> 1 THEN 'stored' ELSE title END AS title, source_type FROM docs""")
def migrated_documents(spark, sf_dir):
    old_docs, old_chunks, stored, now = _old_store(spark, sf_dir)
    return legacy.migrate(stored, now, old_docs, old_chunks)[0].select("document_id", "title", "source_type")


@query(T.with_ctes(T.DOCS, T.CHUNKS) + "SELECT chunk_id, content FROM chunks")
def migrated_chunk_store(spark, sf_dir):
    old_docs, old_chunks, stored, now = _old_store(spark, sf_dir)
    return legacy.migrate(stored, now, old_docs, old_chunks)[1].select("chunk_id", "content")
