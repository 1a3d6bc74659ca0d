"""URL lists: text files with raw links, bullets or markdown links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# What a link looks like, and the characters prose leaves behind it.
URL_RE = r"https?://\S+"
TRAILING = ".,);]\"'"


def urls_in_lines(lines: DataFrame, order: list[str], line_col: str = "line") -> DataFrame:
    """Distinct links of the lines, with the place of their first appearance.

    Blank lines and lines that start with ``#`` are skipped. ``order`` names the
    columns that order the lines; the result keeps the smallest of them per url.
    """
    text = strip(line_col)
    found = lines.where((text != "") & ~text.startswith("#")).select(
        *order, F.posexplode(F.regexp_extract_all(F.col(line_col), F.lit(URL_RE), F.lit(0))).alias("_pos", "_raw")
    )
    return (
        found.select(F.rtrim("_raw", F.lit(TRAILING)).alias("url"), F.struct(*order, "_pos").alias("_at"))
        .groupBy("url").agg(F.min("_at").alias("first_seen"))
        .select("url", *[F.col(f"first_seen.{c}").alias(c) for c in order], F.col("first_seen._pos").alias("pos"))
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Links of one or more list files: ``url, file, line_no, pos``."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("line_no", "line"))
    return urls_in_lines(lines, ["file", "line_no"])
