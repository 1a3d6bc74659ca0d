"""Run streams over file sources until the available input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import new_work_dir
from ..sources.store import CorpusStore


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Write a stream's rows once, exactly, to the shared folder and read them back."""
    work = new_work_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/out")


def sync_stream(log_stream: DataFrame, store: CorpusStore, checkpoint: str,
                now: Callable[[int], str], source_type: str = "docs") -> None:
    """Apply every micro-batch of a fetch-log stream to a store.

    The stream's own id, which its checkpoint keeps, and the batch number name the run, and a run is applied
    once. So a batch that is repeated after a failure changes nothing, and another stream, or
    one whose checkpoint was reset, has runs of its own.
    """
    spark = log_stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the stream's id is not known here")
        store.sync_pages(batch, f"stream-{stream}-{number}", now(number), source_type)

    query = (
        log_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
