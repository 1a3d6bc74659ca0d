"""Move documents and chunks from an older store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_SOURCE_TYPE = "docs"


def read_legacy(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                partitions: int, **options: str) -> DataFrame:
    """A table of the old database, read in parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc").options(**options)
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions))
        .load()
    )


def decode_json(column: str, df: DataFrame, ddl: str) -> Column:
    """A list or object column that may have been stored as JSON text."""
    if df.schema[column].dataType.simpleString() == "string":
        return F.from_json(F.col(column), ddl)
    return F.col(column)


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def legacy_documents(rows: DataFrame) -> DataFrame:
    """Old document rows with defaults for what may be missing."""
    none = F.lit(None).cast("string")
    text = {c: _or(rows, c, none).alias(c) for c in
            ("url", "content_path", "lang", "etag", "last_modified", "content_hash")}
    meta = decode_json("metadata", rows, "map<string,string>") if "metadata" in rows.columns else F.lit(None)
    times = {c: (F.col(c).cast("timestamp") if c in rows.columns else F.lit(None).cast("timestamp")).alias(c)
             for c in ("last_crawled_at", "created_at", "updated_at")}
    return rows.select(
        F.col("document_id").cast("string").alias("document_id"),
        _or(rows, "title", F.lit("")).alias("title"), _or(rows, "description", F.lit("")).alias("description"),
        text["url"], text["content_path"],
        F.coalesce(F.nullif(_or(rows, "source_type", F.lit("")), F.lit("")), F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
        text["lang"], text["etag"], text["last_modified"], text["content_hash"],
        F.coalesce(meta.cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        *times.values(),
    )


def legacy_chunks(rows: DataFrame) -> DataFrame:
    """Old chunk rows with decoded lists and defaults."""
    path = decode_json("section_path", rows, "array<string>") if "section_path" in rows.columns else F.lit(None)
    return rows.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"),
        _or(rows, "content", F.lit("")).alias("content"),
        _or(rows, "chunk_index", F.lit(0)).cast("int").alias("chunk_index"),
        F.coalesce(path.cast("array<string>"), F.array().cast("array<string>")).alias("section_path"),
        _or(rows, "anchor", F.lit(None).cast("string")).alias("anchor"),
        _or(rows, "char_start", F.lit(0)).cast("int").alias("char_start"),
        _or(rows, "char_end", F.lit(0)).cast("int").alias("char_end"),
        F.coalesce(F.nullif(_or(rows, "source_type", F.lit("")), F.lit("")), F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
        decode_json("embedding", rows, "array<float>").alias("embedding"),
    )


def index_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's title, url and path; a missing document leaves defaults."""
    parent = documents.select(
        "document_id", F.col("title").alias("document_title"), F.col("url").alias("document_url"),
        F.col("content_path").alias("document_content_path"),
    )
    return chunks.join(parent, "document_id", "left").withColumn(
        "document_title", F.coalesce("document_title", F.lit(""))
    )


def one_per_key(rows: DataFrame, key: str, order: str | None, last: bool) -> DataFrame:
    """The first or last row of each key by ``order``; without an order, or within ties, by a hash of the row."""
    by = ([F.col(order)] if order else []) + [F.sha2(F.to_json(F.struct(*rows.columns)), 256)]
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() if last else c.asc() for c in by]))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Stored rows plus the incoming ones whose key is not stored yet, the first of those that share a key."""
    new = incoming.join(existing.select(key), key, "left_anti")
    return existing.unionByName(one_per_key(new, key, order, last=False).select(*existing.columns))


def insert_or_replace(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Incoming rows, the last of those that share a key, plus the stored ones they do not replace."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(one_per_key(incoming, key, order, last=True))


def migrate(documents: DataFrame, chunks: DataFrame, legacy_docs: DataFrame, legacy_chunk_rows: DataFrame,
            dry_run: bool = False) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Merge the old store into the new tables: documents, chunks, and a row of counts.

    A dry run gives the counts only.
    """
    docs, rows = legacy_documents(legacy_docs), legacy_chunks(legacy_chunk_rows)
    plain = rows.drop("embedding")
    docs, plain = one_per_key(docs, "document_id", None, last=False), one_per_key(plain, "chunk_id", None, last=True)
    new = docs.join(documents.select("document_id"), "document_id", "left_anti")
    counts = (
        new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents_inserted").alias("kind"), "n")
        .unionByName(plain.agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunks_written").alias("kind"), "n"))
        .unionByName(rows.where("embedding is not null").agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("vectors_written").alias("kind"), "n"))
    )
    if dry_run:
        return None, None, counts
    return (
        insert_or_ignore(documents, docs, "document_id"),
        insert_or_replace(chunks.select(*plain.columns), plain, "chunk_id"),
        counts,
    )
