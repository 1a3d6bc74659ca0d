"""Write conversations as markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_conversations(parts: DataFrame, path: str) -> None:
    """Write exported conversations, one folder per conversation and one text file per part.

    ``parts`` is the output of ``conversation_markdown``. The file name becomes
    part of the folder, with the conversation id so that equal titles stay apart.
    """
    named = parts.select(
        F.concat_ws("_", F.regexp_replace("file_name", r"\.md$", ""), "conversation_id").alias("conversation"),
        F.lpad(F.col("part").cast("string"), 10, "0").alias("part"),
        F.col("markdown").alias("value"),
    )
    # The writer ends each value with one more line break.
    (
        named.repartition("conversation", "part").write.mode("overwrite").option("lineSep", "\n")
        .partitionBy("conversation", "part").text(path)
    )
