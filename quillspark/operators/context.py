"""From ranked chunks to context text: neighbours, spans, search results, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CRUMB, is_blank, strip
from ..session import broadcast_if_small
from .ordered import last_before, running_sum
from .search import DEFAULT_SOURCE_TYPE

EXPANSION_WINDOW = 1
DOCUMENT_MAX_CHARS = 120_000

# Texts of the tool answers.
NO_RESULTS = "No relevant chunks found. Try a different query or strategy."
RESULT_SEPARATOR = "\n\n---\n\n"

_PAYLOAD = (
    "chunk_id", "document_id", "document_title", "document_url", "document_content_path",
    "source_type", "section_path", "anchor", "chunk_index", "content",
)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = EXPANSION_WINDOW,
               keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Stored chunks whose index lies within ``window`` of a hit in the same document.

    The range condition is turned into equal keys by listing the wanted indexes.
    """
    near = F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)
    wanted = hits.select(*keys, "document_id", F.explode(near).alias("chunk_index")).distinct()
    return broadcast_if_small(wanted).join(chunks, ["document_id", "chunk_index"])


def expand_and_merge(hits: DataFrame, chunks: DataFrame, window: int = EXPANSION_WINDOW) -> DataFrame:
    """Widen each hit by its neighbours and merge runs of consecutive chunks into spans.

    ``hits`` are citation rows of one or many queries. A span is cited by its
    first retrieved chunk; spans are ordered by the best rank of their document,
    then by position. With window 0 the hits come back one per span.
    """
    found = hits.select("query_id", *_PAYLOAD, F.lit(0).alias("_origin"))
    if window > 0:
        have = set(chunks.columns)
        near = neighbours(hits.where(F.col("document_id") != ""), chunks, window).select(
            "query_id",
            *[F.col(c) if c in have else F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in _PAYLOAD],
            F.lit(1).alias("_origin"),
        )
        same = Window.partitionBy("query_id", "document_id", "chunk_id").orderBy("_origin")
        found = (
            found.unionByName(near).repartition("query_id", "document_id").where(F.col("chunk_id").isNotNull())
            .withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
        )
        # At most k hits per query, each with 2·window neighbours, meet in these windows.
        run = Window.partitionBy("query_id", "document_id").orderBy("chunk_index")
        found = found.withColumn("_island", F.col("chunk_index") - F.row_number().over(run))
    else:
        found = found.withColumn("_island", F.concat_ws("-", "document_id", "chunk_id"))
    cited = F.min_by(
        F.struct("chunk_id", "section_path", "anchor", "chunk_index", "source_type"),
        F.struct("_origin", "chunk_index"),
    )
    lead = F.min_by(F.struct("document_title", "document_url", "document_content_path"), "chunk_index")
    spans = found.groupBy("query_id", "document_id", "_island").agg(
        cited.alias("c"), lead.alias("l"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"]),
            "\n\n",
        ).alias("content"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    best = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("document_rank"))
    position = Window.partitionBy("query_id").orderBy("document_rank", "c.chunk_index")
    return spans.join(best, ["query_id", "document_id"]).select(
        "query_id", F.row_number().over(position).alias("position"), "document_id", "document_rank",
        F.col("l.document_title").alias("document_title"), F.col("l.document_url").alias("document_url"),
        F.col("l.document_content_path").alias("document_content_path"),
        F.coalesce("c.source_type", F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
        "content", F.col("c.section_path").alias("section_path"), F.col("c.anchor").alias("anchor"),
        F.col("c.chunk_id").alias("chunk_id"), F.col("c.chunk_index").alias("chunk_index"), "n_chunks",
    )


def _marker(chunk_id: Column) -> Column:
    return F.when(F.coalesce(chunk_id, F.lit("")) != "", F.concat(F.lit("[c:"), chunk_id, F.lit("] "))).otherwise("")


def search_text(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """One tool answer per query: marked, titled entries in order, or the fixed empty answer."""
    crumb = F.nullif(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), CRUMB), F.lit(""))
    title = F.coalesce(F.nullif("document_title", F.lit("")), F.lit("Unknown Document"))
    entry = F.concat(
        _marker(F.col("chunk_id")), F.concat_ws(CRUMB, title, crumb), F.lit("\n"), F.coalesce("content", F.lit(""))
    )
    texts = spans.select("query_id", "position", entry.alias("entry")).groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda s: s["entry"]),
            RESULT_SEPARATOR,
        ).alias("text"),
        F.count(F.lit(1)).alias("n_results"),
    )
    return queries.select("query_id").join(texts, "query_id", "left").select(
        "query_id", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("text", F.lit(NO_RESULTS)).alias("text"),
    )


def render_documents(requests: DataFrame, documents: DataFrame, chunks: DataFrame,
                     max_chars: int = DOCUMENT_MAX_CHARS, allowed_ids: DataFrame | None = None) -> DataFrame:
    """Full text of each requested document under a character cap, or an error row.

    ``requests(document_id)``; ``allowed_ids(document_id)`` is the library the ids
    must belong to. A breadcrumb is written only where it changes; the text ends
    at the last chunk that fits and then says how many were left out.
    """
    wanted = requests.select(strip("document_id").alias("document_id")).distinct()
    known = documents.select("document_id", "title")
    checked = wanted.join(known.withColumn("_found", F.lit(True)), "document_id", "left")
    if allowed_ids is not None:
        library = allowed_ids.select("document_id").distinct().withColumn("_allowed", F.lit(True))
        checked = checked.join(library, "document_id", "left")
    else:
        checked = checked.withColumn("_allowed", F.lit(True))
    checked = checked.select(
        "document_id", "title",
        F.when(F.coalesce("document_id", F.lit("")) == "", F.lit("missing required parameter: document_id"))
        .when(F.col("_allowed").isNull(), F.concat(
            F.lit("document_id '"), F.col("document_id"),
            F.lit("' is not in the current library. Only ids from prior search results are valid.")))
        .when(F.col("_found").isNull(), F.concat(F.lit("document not found: "), F.col("document_id")))
        .alias("error"),
    )
    readable = broadcast_if_small(checked.where("error is null").select("document_id", "title"))
    crumb = F.nullif(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), CRUMB), F.lit(""))
    rows = (
        chunks.select("document_id", "chunk_id", "chunk_index", "content", "section_path")
        .join(readable, "document_id")
        .select("document_id", "title", "chunk_id", "chunk_index", strip("content").alias("content"), crumb.alias("crumb"))
    )
    filled = rows.where(F.col("content") != "")
    seen = last_before(filled, ["document_id"], "chunk_index", F.col("crumb"), "seen", source=chunks)
    heading = F.when(
        F.col("crumb").isNotNull() & ~F.col("crumb").eqNullSafe(F.col("seen")), F.concat("crumb", F.lit("\n\n"))
    ).otherwise("")
    pieces = seen.withColumn("piece", F.concat(_marker(F.col("chunk_id")), heading, F.col("content")))
    header = F.concat(F.lit("# "), F.coalesce("title", F.lit("Unknown Document")), F.lit("\n"))
    sized = running_sum(pieces, ["document_id"], "chunk_index", F.length("piece") + 2, "used", source=chunks)
    fits = F.length(header) + F.col("used") <= max_chars
    # What is collected per document is bounded by max_chars.
    texts = sized.groupBy("document_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("chunk_index", "piece")))), lambda s: s["piece"]),
            "\n\n",
        ).alias("body"),
        F.count_if(fits).alias("kept_chunks"),
        F.count_if(~fits).alias("dropped_chunks"),
    )
    present = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    note = F.concat(
        F.lit("\n\n\n[document truncated — "), F.col("dropped_chunks").cast("string"),
        F.lit(f" more chunks omitted to stay within the {max_chars}-character cap for tool responses]"),
    )
    body = F.coalesce(F.col("body"), F.lit(""))
    text = F.concat(
        header, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""),
        F.when(F.col("dropped_chunks") > 0, note).otherwise(""),
    )
    out = checked.join(present, "document_id", "left").join(texts, "document_id", "left")
    error = F.coalesce(
        F.col("error"),
        F.when(F.col("total_chunks").isNull(), F.concat(F.lit("no chunks available for document: "), F.col("document_id"))),
    )
    return out.select(
        "document_id", error.isNull().alias("ok"), error.alias("error"),
        F.when(error.isNull(), text).alias("text"),
        F.coalesce("kept_chunks", F.lit(0)).alias("kept_chunks"),
        F.coalesce("dropped_chunks", F.lit(0)).alias("dropped_chunks"),
    )


def readable_chunks(requests: DataFrame, library: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the requested documents that belong to the library, in reading order."""
    ids = requests.select("document_id").join(library.select("document_id"), "document_id", "left_semi").distinct()
    return chunks.join(broadcast_if_small(ids), "document_id", "left_semi").where(~is_blank("content"))
