"""A search index kept up to date by runs that write only what they change.

Each run adds one folder to every table, ``<table>/run=<n>``:

``chunks``, ``chunk_terms``, ``vectors``   rows of the documents that are new or changed
``touched``        ids of the documents that the run replaced or took out (not for the first run)
``term_changes``   signed change of the document frequency of each term
``size_changes``   one row: signed change of the number of chunks and of their terms
``applied``        one row, written last: readers see the runs up to the newest one here

Statistics are sums over runs. A row is live unless a later run touched its document. Nothing that a run doesn't touch is
read as a whole or written again: old terms of touched documents come from one semi join over the narrow term table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TERM_RE
from ..session import broadcast_if_small, settle
from .embedding import DIM, Embedder, embed
from .index import chunk_term_rows, embedder_name

_DATA = ("chunks", "chunk_terms", "vectors")


@dataclass(frozen=True)
class LiveIndex:
    """Takes part in every search as an ``Index`` does. One writer at a time; readers may read meanwhile."""

    spark: SparkSession
    path: str

    # --- state ---

    def _runs(self, name: str, last: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.where(F.col("run") <= (self.last_run() if last is None else last))

    def last_run(self) -> int:
        return self.spark.read.parquet(f"{self.path}/applied").agg(F.max("run")).first()[0]

    def live(self, name: str, last: int | None = None) -> DataFrame:
        """Rows of ``name`` whose document no later run has touched."""
        last = self.last_run() if last is None else last
        rows = self._runs(name, last)
        if last == 0:
            return rows.drop("run")
        newest = self._runs("touched", last).groupBy("document_id").agg(F.max("run").alias("_newest"))
        stale = (F.col("_newest") > F.col("run")) & (newest["document_id"] == rows["document_id"])
        return rows.join(broadcast_if_small(newest), stale, "left_anti").drop("run")

    @property
    def chunks(self) -> DataFrame:
        return self.live("chunks")

    @property
    def chunk_terms(self) -> DataFrame:
        return self.live("chunk_terms").drop("document_id")

    @property
    def vectors(self) -> DataFrame:
        return self.live("vectors").drop("document_id")

    @property
    def term_stats(self) -> DataFrame:
        """term, df over the live chunks."""
        return self._runs("term_changes").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def corpus_stats(self) -> DataFrame:
        """One row: n_chunks and avg_dl of the live chunks (null when there are none)."""
        sums = self._runs("size_changes").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("dl").alias("_dl"))
        return sums.select("n_chunks", F.try_divide(F.col("_dl"), F.col("n_chunks")).alias("avg_dl"))

    @property
    def settings(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/settings").first()

    # --- changes ---

    def _write(self, df: DataFrame, name: str, run: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        return self.spark.read.parquet(f"{self.path}/{name}/run={run}")

    def _add(self, chunks: DataFrame, gone: DataFrame | None, run: int, dim: int, embedder: Embedder | None, term_re: str) -> int:
        chunks = self._write(chunks, "chunks", run)
        terms = chunk_term_rows(chunks, term_re, keep=("document_id",)).where(F.col("chunk_id").isNotNull())
        # a chunk id of several rows stands for each of their documents; only ids are shuffled to find those
        owners = chunks.groupBy("chunk_id").agg(F.collect_list(F.struct("document_id")).alias("owners")).where(F.size("owners") > 1)
        owners = settle(owners, "repeated-chunks")
        if not owners.isEmpty():
            each = F.explode(F.coalesce("owners", F.array(F.struct("document_id")))).alias("of")
            terms = terms.join(broadcast_if_small(owners), "chunk_id", "left").select("chunk_id", "source_type", "dl", "terms", each)
            terms = terms.select("chunk_id", "source_type", "dl", "terms", "of.document_id")
        terms = self._write(terms, "chunk_terms", run)
        vectors = embed(chunks.select("chunk_id", "document_id", "source_type", "content"), "content", "embedding", dim, embedder)
        self._write(vectors.drop("content"), "vectors", run)
        signed = terms.select("dl", "terms", F.lit(1).alias("sign"))
        if gone is not None:
            touched = chunks.select("document_id").unionByName(gone.select("document_id")).distinct()
            touched = self._write(touched, "touched", run)
            old = self.live("chunk_terms", run - 1).join(broadcast_if_small(touched), "document_id", "left_semi")
            signed = signed.unionByName(old.select("dl", "terms", F.lit(-1).alias("sign")))
        changes = signed.select("sign", F.explode("terms.term").alias("term")).groupBy("term").agg(F.sum("sign").alias("df"))
        self._write(changes.where("df != 0"), "term_changes", run)
        zero = F.lit(0).cast("bigint")
        self._write(signed.agg(F.coalesce(F.sum("sign"), zero).alias("n_chunks"),
                               F.coalesce(F.sum(F.col("sign") * F.col("dl")), zero).alias("dl")), "size_changes", run)
        self.spark.createDataFrame([(run,)], "run int").write.mode("overwrite").parquet(f"{self.path}/applied/n={run}")
        return run

    def apply(self, chunks: DataFrame, gone: DataFrame | None = None, embedder: Embedder | None = None) -> int:
        """One run: ``chunks`` replace all chunks of their documents, documents in ``gone(document_id)`` leave. Returns its number.

        A document that is in both has its new chunks. Ids that the index doesn't hold are no error. A run that died is
        written again under its number by the next one.
        """
        set_up = self.settings
        if embedder_name(embedder) != set_up["embedder"]:
            raise ValueError(f"the index was embedded by {set_up['embedder']}, not by {embedder_name(embedder)}")
        gone = chunks.select("document_id").limit(0) if gone is None else gone
        return self._add(chunks, gone, self.last_run() + 1, set_up["dim"], embedder, set_up["term_re"])

    def delete(self, ids: DataFrame) -> int:
        """Take the documents ``ids(document_id)`` out, with their chunks, terms and vectors."""
        rows = self._runs("chunks").drop("run").limit(0)
        return self._add(rows, ids, self.last_run() + 1, self.settings["dim"], None, self.settings["term_re"])

    def compact(self, path: str) -> LiveIndex:
        """The same index with its live rows only, as the first run of a new folder."""
        new = LiveIndex(self.spark, path)
        last = self.last_run()
        for name in _DATA:
            new._write(self.live(name, last), name, 0)
        new._write(self.term_stats, "term_changes", 0)
        new._write(self._runs("size_changes", last).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("dl").alias("dl")), "size_changes", 0)
        self.spark.read.parquet(f"{self.path}/settings").write.mode("overwrite").parquet(f"{path}/settings")
        self.spark.createDataFrame([(0,)], "run int").write.mode("overwrite").parquet(f"{path}/applied/n=0")
        return new


def create(chunks: DataFrame, path: str, dim: int = DIM, embedder: Embedder | None = None, term_re: str = TERM_RE) -> LiveIndex:
    """A new index over ``chunks`` (chunk_id, document_id, source_type, content and any payload)."""
    spark = chunks.sparkSession
    index = LiveIndex(spark, path)
    spark.createDataFrame([(term_re, dim, embedder_name(embedder))], "term_re string, dim int, embedder string").write.mode("overwrite").parquet(f"{path}/settings")
    index._add(chunks, None, 0, dim, embedder, term_re)
    return index
