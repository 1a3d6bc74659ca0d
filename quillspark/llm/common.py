"""What the operators of this subpackage share: inputs, Arrow slices, learning splits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 2048
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text`` of each row, a null text as the empty one; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``rows`` rows and about ``size`` bytes of ``column``.

    A single longer row is a slice of its own.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and (held + n > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str,
               column: str = "text", **limits: int) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``make`` builds the worker's state once per task."""

    def run(batches):
        step = make()
        for part in slices(batches, column, **limits):
            yield step(part)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]], size: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which the worker's step gives true.

    The step gets slices with all columns; their ``text`` may be null.
    """

    def run(batches):
        step = make()
        for part in slices(batches, size=size):
            yield part.filter(step(part))

    return df.mapInArrow(run, df.schema)


def filled(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a slice, null ones as empty."""
    return pa.compute.fill_null(batch.column("text"), "")


def learnable(doc_id: str | Column = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1
