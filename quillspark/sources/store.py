"""Corpus tables on plain Parquet, replaced by atomic snapshots.

A run writes the new document table and only the chunks and vectors of changed
documents, all below ``v=<n>``; a marker file makes version n current. Each
document names the version its chunks were written in, so readers take live
chunks with one semi join and unchanged chunks are never rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import DIM, Embedder, embed
from ..operators.ingest import (
    merge_documents, run_summary, stage_pages, stage_vault, staged_chunk_rows, sync_items,
)
from ..schemas import DOCUMENTS, SYNC_ITEMS, SYNC_RUNS

_MARKER = "_COMMITTED"
_CLAIM = "_WRITER"


class CorpusStore:
    """Documents, chunks, vectors and sync audit of one corpus."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions ---

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int | None:
        """The newest version whose marker exists."""
        path, fs = self._fs(f"{self.root}/v=*/{_MARKER}")
        found = fs.globStatus(path) or []
        numbers = [int(s.getPath().getParent().getName().split("=")[1]) for s in found]
        return max(numbers, default=None)

    def _mark(self, version: int) -> None:
        path, fs = self._fs(f"{self.root}/v={version}/{_MARKER}")
        fs.create(path, False).close()

    @contextmanager
    def _writing(self) -> Iterator[int]:
        """The next version's number, claimed by a file that only one writer can create."""
        current = self.version()
        version = 0 if current is None else current + 1
        path, fs = self._fs(f"{self.root}/{_CLAIM}")
        try:
            fs.create(path, False).close()
        except Exception as error:
            if not fs.exists(path):
                raise
            raise RuntimeError(f"{self.root} has a writer; if it died, call release_claim()") from error
        try:
            if self.version() != current:
                raise RuntimeError(f"{self.root} was written meanwhile; run again")
            yield version
        finally:
            fs.delete(path, False)

    def release_claim(self) -> None:
        """Let others write after a writer died; what it left of its version is overwritten."""
        path, fs = self._fs(f"{self.root}/{_CLAIM}")
        fs.delete(path, False)

    # --- reads ---

    def _current(self, name: str, schema: str) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/v={version}/{name}")

    def _documents(self) -> DataFrame:
        return self._current("documents", DOCUMENTS + ", chunk_version int")

    def documents(self) -> DataFrame:
        return self._documents().drop("chunk_version")

    def _all_versions(self, name: str) -> DataFrame | None:
        current = self.version()
        if current is None:
            return None
        paths = [f"{self.root}/v={v}/{name}" for v in range(current + 1) if self._has(f"{self.root}/v={v}/{name}/_SUCCESS")]
        return self.spark.read.option("basePath", self.root).parquet(*paths)

    def _has(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _live(self, name: str) -> DataFrame | None:
        rows = self._all_versions(name)
        if rows is None:
            return None
        owners = self._documents().select("document_id", F.col("chunk_version").alias("v"))
        return rows.join(owners, ["document_id", "v"], "left_semi").drop("v")

    def chunks(self) -> DataFrame | None:
        """Live chunks with their document's payload, null before the first run."""
        return self._live("chunks")

    def vectors(self) -> DataFrame | None:
        return self._live("vectors")

    def runs(self) -> DataFrame:
        return self._audit("runs", SYNC_RUNS)

    def items(self) -> DataFrame:
        return self._audit("items", SYNC_ITEMS)

    def _audit(self, name: str, schema: str) -> DataFrame:
        rows = self._all_versions(name)
        return self.spark.createDataFrame([], schema) if rows is None else rows.drop("v")

    # --- writes ---

    def sync_pages(self, log: DataFrame, run_id: str, now: str, source_type: str = "docs",
                   dim: int = DIM, embedder: Embedder | None = None) -> DataFrame:
        """Ingest one fetch run; returns its summary row. A run id is applied once."""
        return self._sync("url_list", lambda docs: stage_pages(log, docs, source_type), run_id, now, dim, embedder)

    def sync_vault(self, files: DataFrame, run_id: str, now: str, source_type: str = "docs",
                   dim: int = DIM, embedder: Embedder | None = None) -> DataFrame:
        """Ingest one pass over a markdown tree; returns its summary row."""
        return self._sync("vault", lambda docs: stage_vault(files, docs, source_type), run_id, now, dim, embedder)

    def _sync(self, kind: str, stage: Callable[[DataFrame], DataFrame], run_id: str, now: str,
              dim: int, embedder: Embedder | None) -> DataFrame:
        done = self.runs().where(F.col("run_id") == run_id)
        if done.limit(1).count():
            return done
        with self._writing() as version:
            return self._write(kind, stage, run_id, now, dim, embedder, version)

    def _write(self, kind: str, stage: Callable[[DataFrame], DataFrame], run_id: str, now: str,
               dim: int, embedder: Embedder | None, version: int) -> DataFrame:
        base = f"{self.root}/v={version}"
        stamp = F.lit(now).cast("timestamp")
        documents = self._documents()

        # Written once: chunking and hashing must not run again per output table.
        stage(documents.drop("chunk_version")).write.mode("overwrite").parquet(f"{base}/staged")
        staged = self.spark.read.parquet(f"{base}/staged")

        staged_chunk_rows(staged).write.mode("overwrite").parquet(f"{base}/chunks")
        chunks = self.spark.read.parquet(f"{base}/chunks")
        embed(chunks.select("chunk_id", "document_id", "source_type", "content"), "content", "embedding", dim, embedder) \
            .drop("content").write.mode("overwrite").parquet(f"{base}/vectors")

        merged = merge_documents(documents.drop("chunk_version"), staged, stamp)
        changed = staged.where(F.col("outcome").isin("ingested", "updated")).select(
            "document_id", F.lit(version).alias("_new_version")
        )
        merged.join(changed, "document_id", "left").join(
            documents.select("document_id", "chunk_version"), "document_id", "left"
        ).withColumn("chunk_version", F.coalesce("_new_version", "chunk_version")).drop("_new_version") \
            .write.mode("overwrite").parquet(f"{base}/documents")

        items = sync_items(staged, F.lit(run_id), stamp)
        items.write.mode("overwrite").parquet(f"{base}/items")
        zero = {c: F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in
                ("items_total", "items_new", "items_updated", "items_unchanged", "items_error")}
        run_summary(self.spark.read.parquet(f"{base}/items")).agg(*zero.values()).select(
            F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit("completed").alias("status"),
            *zero, stamp.alias("started_at"), stamp.alias("finished_at"),
        ).write.mode("overwrite").parquet(f"{base}/runs")
        self._mark(version)
        return self.spark.read.parquet(f"{base}/runs")

    def delete_documents(self, ids: DataFrame, run_id: str, now: str) -> DataFrame:
        """Take ``ids(document_id)`` out, with their chunks and vectors; returns the run's row. A run id is applied once.

        Only the document table is written: chunks and vectors are live as long as their document names
        their version. Unknown ids are no error and have no item.
        """
        done = self.runs().where(F.col("run_id") == run_id)
        if done.limit(1).count():
            return done
        with self._writing() as version:
            base, stamp = f"{self.root}/v={version}", F.lit(now).cast("timestamp")
            gone = ids.select("document_id").distinct()
            documents = self._documents()
            documents.join(gone, "document_id", "left_anti").write.mode("overwrite").parquet(f"{base}/documents")
            items = documents.join(gone, "document_id", "left_semi").select(
                F.sha2(F.concat_ws(":", F.lit(run_id), "document_id"), 256).alias("item_id"), F.lit(run_id).alias("run_id"),
                F.coalesce("url", "content_path", "document_id").alias("source_ref"), F.lit("deleted").alias("outcome"),
                F.lit(None).cast("string").alias("error_message"), stamp.alias("created_at"))
            items.write.mode("overwrite").parquet(f"{base}/items")
            none = F.lit(0).cast("bigint")
            self.spark.read.parquet(f"{base}/items").agg(F.count(F.lit(1)).alias("items_total")).select(
                F.lit(run_id).alias("run_id"), F.lit("delete").alias("kind"), F.lit("completed").alias("status"), "items_total",
                *[none.alias(c) for c in ("items_new", "items_updated", "items_unchanged", "items_error")],
                stamp.alias("started_at"), stamp.alias("finished_at"),
            ).write.mode("overwrite").parquet(f"{base}/runs")
            self._mark(version)
            return self.spark.read.parquet(f"{base}/runs")
