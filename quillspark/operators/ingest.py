"""Incremental ingest: classify what was fetched, merge documents, count outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sections import parse_sections, section_title
from ..functions.text import (
    TOKEN_RE, decode_html, decode_markdown, detect_format, html_lang, html_title, html_to_markdown,
    is_blank,
)
from ..schemas import SECTION_TYPE
from .chunking import MAX_TOKENS, chunk_contents, has_paragraphs, locate_chunks, section_parts

_CHUNKS_TYPE = "array<struct<content:string,section_path:array<string>>>"


def _spread_nulls(key: str, other: str) -> Column:
    """A join key in which missing values differ from each other and match nothing."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(other)))


def classify_fetch(log: DataFrame) -> DataFrame:
    """Add ``status`` (ok, not_modified, skipped_robots, error) and ``error`` to a fetch log."""
    bad_scheme = ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    code = F.col("http_status")
    none = F.lit(None).cast("string")
    failed = (
        F.when(bad_scheme, F.lit("invalid_scheme"))
        .when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string")))
    )
    allowed = F.coalesce(F.col("robots_allowed"), F.lit(True))
    return log.withColumn(
        "status",
        F.when(bad_scheme, "error").when(~allowed, "skipped_robots").when(failed.isNotNull(), "error")
        .when(code == 304, "not_modified").otherwise("ok"),
    ).withColumn("error", F.when(bad_scheme | allowed, failed).otherwise(none))


def extract_pages(fetched: DataFrame) -> DataFrame:
    """Add ``source_format, body, page_title, lang`` to rows with content.

    Only HTML and markdown have an extractor; a PDF keeps a null body.
    """
    with_format = fetched.withColumn(
        "source_format", F.when(F.length("content") > 0, detect_format("content", "content_type"))
    )
    decoded = with_format.withColumn(
        "_text",
        F.when(F.col("source_format") == "html", decode_html("content"))
        .when(F.col("source_format") == "markdown", decode_markdown("content")),
    )
    is_html = F.col("source_format") == "html"
    # Kept as a column of its own: the chain of replacements must run once per page.
    converted = decoded.withColumn("_markdown", F.when(is_html, html_to_markdown("_text")))
    return converted.select(
        *with_format.columns,
        F.when(is_html, F.when(F.col("_markdown") != "", F.col("_markdown")))
        .otherwise(F.when(~is_blank("_text"), F.col("_text"))).alias("body"),
        F.when(is_html, html_title("_text")).alias("page_title"),
        F.when(is_html, html_lang("_text")).alias("page_lang"),
    )


def stage_chunks(rows: DataFrame, needed: Column, max_tokens: int = MAX_TOKENS,
                 token_re: str = TOKEN_RE) -> DataFrame:
    """Add ``sections``, ``has_chunks``, and the ``chunks`` and ``spans`` arrays where ``needed``.

    Whether a document has chunks is known before it is tokenised, so outcomes
    alone never pay for the chunking.
    """
    there = F.col("body").isNotNull()
    return (
        rows.withColumn("sections", F.when(there, parse_sections("body")).cast(SECTION_TYPE))
        .withColumn("_parts", F.when(needed & there, section_parts(F.col("body"), F.col("sections"))))
        .withColumn("has_chunks", has_paragraphs(F.col("_parts")))
        .withColumn("chunks", F.when(F.col("has_chunks"), chunk_contents(
            F.col("_parts"), max_tokens, token_re)).cast(_CHUNKS_TYPE))
        .withColumn("spans", F.when(F.col("chunks").isNotNull(), locate_chunks(
            F.transform("chunks", lambda c: c["content"]), F.col("body"))))
        .drop("_parts")
    )


def latest_fetches(log: DataFrame) -> DataFrame:
    """One row per url of a fetch log, so that a url that was tried again is one item.

    The last by ``fetched_at`` where the log has that column and it is set; then one that was read before
    one that failed, then the smallest content hash. Rows without a url all stay.
    """
    read = F.col("fetch_error").isNull() & (F.coalesce("http_status", F.lit(0)) < 400)
    last = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in log.columns else []
    order = Window.partitionBy("url").orderBy(*last, read.desc(), F.sha2("content", 256).asc_nulls_last(), F.col("etag").asc_nulls_last())
    first = log.where("url IS NOT NULL").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return first.unionByName(log.where("url IS NULL"))


def superseded_fetches(log: DataFrame) -> DataFrame:
    """``url, n_superseded``: urls that a log names more than once, and how many of their rows don't count."""
    return log.where("url IS NOT NULL").groupBy("url").agg((F.count(F.lit(1)) - 1).alias("n_superseded")).where("n_superseded > 0")


def stage_pages(log: DataFrame, documents: DataFrame, source_type: str,
                max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Classify one fetch run against the stored documents.

    One row per fetched url (``latest_fetches``) with ``outcome``, ``error_message``, the document
    values to store and the chunk arrays. Checked in this order: fetch error,
    not modified, empty or unreadable body, same hash, no chunks, new or changed.
    """
    stored = documents.where(F.col("url").isNotNull()).select(
        F.col("url"), F.col("document_id").alias("old_id"), F.col("title").alias("old_title"),
        F.col("content_hash").alias("old_hash"),
    )
    # The stored hash decides before the costly text work, so it is joined first.
    fetched = classify_fetch(latest_fetches(log)).join(stored, "url", "left")
    same = F.col("old_hash").eqNullSafe(F.sha2("content", 256)) & F.col("content").isNotNull()
    hashed = fetched.withColumn("new_hash", F.sha2("content", 256)).withColumn("_same", same)
    pages = extract_pages(hashed)
    staged = stage_chunks(pages, (F.col("status") == "ok") & ~F.col("_same"), max_tokens)
    error = (
        F.when(F.col("status") == "skipped_robots", F.lit("skipped by robots.txt"))
        .when(F.col("status") == "not_modified", F.lit(None))
        .when(F.col("status") == "error", F.concat(F.lit("fetch failed: "), F.coalesce("error", F.lit("unknown error"))))
        .when(F.col("content").isNull(), F.lit("crawler returned OK with empty body"))
        .when(F.col("body").isNull(), F.lit("extractor yielded no body (possibly JS-rendered or empty page)"))
        .when(F.col("_same"), F.lit(None))
        .when(~F.col("has_chunks"), F.lit("chunker produced 0 chunks"))
    )
    outcome = (
        F.when(F.col("error_message").isNotNull(), "error")
        .when((F.col("status") == "not_modified") | F.col("_same"), "unchanged")
        .when(F.col("old_id").isNotNull(), "updated").otherwise("ingested")
    )
    return (
        staged.withColumn("error_message", error).withColumn("outcome", outcome)
        .select(
            F.coalesce("old_id", F.sha2(F.concat_ws(":", F.lit("url"), "url"), 256)).alias("document_id"),
            F.col("url").alias("source_ref"), "url", F.lit(None).cast("string").alias("content_path"),
            "outcome", "error_message",
            F.coalesce("page_title", section_title("sections"), "old_title", "url").alias("title"),
            F.lit(None).cast("string").alias("description"), F.lit(source_type).alias("source_type"),
            F.col("page_lang").alias("lang"), "etag", "last_modified",
            F.when(F.col("status") == "ok", F.col("new_hash")).alias("content_hash"),
            F.lit(None).cast("map<string,string>").alias("metadata"),
            "body", "sections", "chunks", "spans",
        )
    )


def stage_vault(files: DataFrame, documents: DataFrame, source_type: str,
                max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Classify one pass over a markdown tree; the hash is checked before anything else.

    ``files(content_path, content, metadata, body)`` as read by the vault source. A
    new note whose url is already taken, by a stored document or by a new note
    with a smaller path, is an error.
    """
    stored = documents.where(F.col("content_path").isNotNull()).select(
        "content_path", F.col("document_id").alias("old_id"), F.col("content_hash").alias("old_hash"),
    )
    hashed = files.withColumn("new_hash", F.sha2("content", 256)).join(stored, "content_path", "left")
    rows = hashed.withColumn("_same", F.col("old_hash").eqNullSafe(F.col("new_hash"))).withColumn(
        "body", F.when(~is_blank("body"), F.col("body"))
    )
    staged = stage_chunks(rows, ~F.col("_same"), max_tokens)

    def meta(key: str) -> Column:
        return F.nullif(F.try_element_at("metadata", F.lit(key)), F.lit(""))

    error = (
        F.when(F.col("_same"), F.lit(None))
        .when(F.col("body").isNull(), F.lit("empty body"))
        .when(~F.col("has_chunks"), F.lit("chunker produced 0 chunks"))
    )
    checked = staged.withColumn("error_message", error).withColumn("url", F.coalesce(meta("source"), meta("url")))
    is_new = F.col("error_message").isNull() & ~F.col("_same") & F.col("old_id").isNull()
    taken = documents.where(F.col("url").isNotNull()).select(F.col("url").alias("_key")).distinct().withColumn("_taken", F.lit(True))
    first = (
        checked.where(is_new & F.col("url").isNotNull()).groupBy(F.col("url").alias("_key"))
        .agg(F.min("content_path").alias("_winner"))
    )
    # Notes without a url get keys of their own, so they do not meet in one task.
    keyed = checked.withColumn("_key", _spread_nulls("url", "content_path"))
    settled = keyed.join(taken, "_key", "left").join(first, "_key", "left").withColumn(
        "error_message",
        F.when(
            is_new & F.col("url").isNotNull()
            & (F.col("_taken").isNotNull() | (F.col("_winner") < F.col("content_path"))),
            F.lit("duplicate url"),
        ).otherwise(F.col("error_message")),
    )
    stem = F.regexp_replace(F.regexp_replace("content_path", "^.*/", ""), r"\.[^.]*$", "")
    outcome = (
        F.when(F.col("error_message").isNotNull(), "error").when(F.col("_same"), "unchanged")
        .when(F.col("old_id").isNotNull(), "updated").otherwise("ingested")
    )
    return settled.select(
        F.coalesce("old_id", F.sha2(F.concat_ws(":", F.lit("path"), "content_path"), 256)).alias("document_id"),
        F.col("content_path").alias("source_ref"), "url", "content_path",
        outcome.alias("outcome"), "error_message",
        F.coalesce(meta("title"), section_title("sections"), stem).alias("title"),
        F.coalesce(meta("description"), F.lit("")).alias("description"),
        F.lit(source_type).alias("source_type"), meta("lang").alias("lang"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.col("new_hash").alias("content_hash"), "metadata", "body", "sections", "chunks", "spans",
    )


def staged_chunk_rows(staged: DataFrame) -> DataFrame:
    """Chunk rows of the new and changed documents of a staged run."""
    from ..functions.sections import with_anchors

    changed = staged.where(F.col("outcome").isin("ingested", "updated"))
    rows = changed.select(
        "document_id", "source_type",
        F.col("title").alias("document_title"), F.col("url").alias("document_url"),
        F.col("content_path").alias("document_content_path"),
        F.posexplode(with_anchors(F.col("chunks"), F.col("spans"), F.col("sections"))).alias("chunk_index", "z"),
    )
    return rows.select(
        F.concat_ws("-", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id",
        F.col("z.c.content").alias("content"), "chunk_index", F.col("z.c.section_path").alias("section_path"),
        F.col("z.anchor").alias("anchor"),
        F.col("z.s.char_start").alias("char_start"), F.col("z.s.char_end").alias("char_end"),
        "source_type", "document_title", "document_url", "document_content_path",
    )


def merge_documents(documents: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """The document table after a run.

    A value that is null in the run never overwrites a stored one; times always
    move. Rows of failed items and documents missing from the run stay as they are.
    """
    # One full join reads the run once, whether its rows patch a document or add one.
    run = staged.where(F.col("outcome") != "error").select(
        "document_id", F.col("outcome").alias("_outcome"),
        *[F.col(c).alias(f"_{c}") for c in (
            "title", "description", "url", "content_path", "source_type", "lang", "etag", "last_modified",
            "content_hash", "metadata")],
    )
    old = documents.withColumn("_stored", F.lit(True))
    both = old.join(run, "document_id", "full").where(
        F.col("_stored").isNotNull() | (F.col("_outcome") == "ingested")
    )
    is_new, seen = F.col("_stored").isNull(), F.col("_outcome").isNotNull()
    changed = seen & (F.col("_outcome") != "unchanged")
    empty = F.create_map().cast("map<string,string>")

    def value(name: str) -> Column:
        if name in ("title", "description", "lang", "metadata"):
            patched = F.coalesce(F.when(changed, F.col(f"_{name}")), F.col(name))
            if name == "description":
                return F.when(is_new, F.coalesce(patched, F.lit(""))).otherwise(patched)
            return F.when(is_new, F.coalesce(patched, empty)).otherwise(patched) if name == "metadata" else patched
        if name in ("etag", "last_modified", "content_hash"):
            return F.coalesce(F.col(f"_{name}"), F.col(name))
        if name in ("url", "content_path", "source_type"):
            return F.when(is_new, F.col(f"_{name}")).otherwise(F.col(name))
        if name in ("last_crawled_at", "updated_at"):
            return F.when(seen, now).otherwise(F.col(name))
        return F.when(is_new, now).otherwise(F.col(name)) if name == "created_at" else F.col(name)

    return both.select(*[value(c).alias(c) for c in documents.columns])


def clear_crawl_state(documents: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Forget etag, last-modified and hash of failed documents, so the next run reads them again."""
    marked = documents.join(failed.select("document_id").distinct().withColumn("_failed", F.lit(True)), "document_id", "left")
    hit = F.coalesce("_failed", F.lit(False))
    return marked.select(*[
        F.when(~hit, F.col(c)).alias(c) if c in ("etag", "last_modified", "content_hash")
        else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
        for c in documents.columns
    ])


def replace_rows(existing: DataFrame, changed_ids: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the changed keys replaced by the new ones."""
    return existing.join(changed_ids.select(key).distinct(), key, "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def reject_duplicate_keys(incoming: DataFrame, documents: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that may be appended, and those whose url or path is taken.

    Taken by a stored document, or by the incoming row that is first with it by ``order`` (default: the
    first column); a row that is first with one key and not with the other is rejected too.
    """
    order = order or incoming.columns[0]
    by_url = documents.where(F.col("url").isNotNull()).select(F.col("url").alias("_uk")).distinct().withColumn("_u", F.lit(True))
    by_path = documents.where(F.col("content_path").isNotNull()).select(F.col("content_path").alias("_pk")).distinct().withColumn("_p", F.lit(True))
    keyed = incoming.withColumns({
        "_uk": _spread_nulls("url", "content_path"), "_pk": _spread_nulls("content_path", "url"),
    })
    ties = [F.col(order), F.sha2(F.to_json(F.struct(*incoming.columns)), 256)]
    numbered = keyed.withColumn("_nu", F.row_number().over(Window.partitionBy("_uk").orderBy(*ties))).withColumn(
        "_np", F.row_number().over(Window.partitionBy("_pk").orderBy(*ties)))
    marked = numbered.join(by_url, "_uk", "left").join(by_path, "_pk", "left").withColumns({
        "_u": F.when(F.col("_u").isNotNull() | (F.col("_nu") > 1), True), "_p": F.when(F.col("_p").isNotNull() | (F.col("_np") > 1), True)})
    clash = F.col("_u").isNotNull() | F.col("_p").isNotNull()
    return (
        marked.where(~clash).select(*incoming.columns),
        marked.where(clash).select(
            *incoming.columns, F.when(F.col("_u").isNotNull(), "duplicate url").otherwise("duplicate content_path").alias("reason")
        ),
    )


def sync_items(staged: DataFrame, run_id: Column, created_at: Column) -> DataFrame:
    """Audit rows of a run, one per source item."""
    return staged.select(
        F.sha2(F.concat_ws(":", run_id, "source_ref"), 256).alias("item_id"), run_id.alias("run_id"),
        "source_ref", "outcome", "error_message", created_at.alias("created_at"),
    )


def run_summary(items: DataFrame) -> DataFrame:
    """Counters per run; whatever is not new, updated or unchanged counts as an error."""
    o = F.col("outcome")
    return items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("items_total"),
        F.count_if(o == "ingested").alias("items_new"),
        F.count_if(o == "updated").alias("items_updated"),
        F.count_if(o == "unchanged").alias("items_unchanged"),
        F.count_if(~F.coalesce(o, F.lit("")).isin("ingested", "updated", "unchanged")).alias("items_error"),
    )


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def run_items(items: DataFrame, run_id: str) -> DataFrame:
    return items.where(F.col("run_id") == run_id).orderBy("created_at", "item_id")
