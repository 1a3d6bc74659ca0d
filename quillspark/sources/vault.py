"""Markdown trees with YAML front matter."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..functions.text import decode_markdown, strip

_BLOCK = r"(?s)^\s*-{3,}[ \t]*\r?\n(.*?)(?:^|\n)-{3,}[ \t]*(?:\r?\n|$)"


def front_matter(text: Column | str) -> Column:
    """The raw YAML between the opening fences, null when the text has none."""
    raw = F.col(text) if isinstance(text, str) else text
    return F.when(raw.rlike(_BLOCK), F.regexp_extract(raw, _BLOCK, 1))


def body_without_front_matter(text: Column | str) -> Column:
    raw = F.col(text) if isinstance(text, str) else text
    return strip(F.regexp_replace(raw, _BLOCK, ""))


def flat_metadata(yaml_text: Column | str) -> Column:
    """Top-level ``key: value`` lines as a map; quotes around a value are dropped.

    A key given twice keeps its last value. Nested values are left to
    ``nested_metadata``.
    """
    raw = F.col(yaml_text) if isinstance(yaml_text, str) else yaml_text
    line_re = r"^([A-Za-z0-9_][A-Za-z0-9_ -]*?)[ \t]*:(?:[ \t]+(.*?))?[ \t\r]*$"
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(line_re))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, line_re, 1).alias("k"),
            F.regexp_replace(F.regexp_extract(line, line_re, 2), r"""^(?:"(.*)"|'(.*)')$""", "$1$2").alias("v"),
        ),
    )
    last = let(pairs, lambda all_pairs: F.filter(
        all_pairs,
        lambda p, i: ~F.exists(F.slice(all_pairs, i + 2, F.size(all_pairs)), lambda q: q["k"] == p["k"]),
    ))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def nested_metadata(yaml_text: pd.Series) -> pd.Series:
    """Full YAML: scalars as text, lists and maps as JSON. Needs PyYAML on the executors."""
    import yaml

    def read(text: str | None) -> dict[str, str]:
        loaded = yaml.safe_load(text) if text else None
        if not isinstance(loaded, dict):
            return {}
        return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in loaded.items() if v is not None}

    return yaml_text.map(read)


def parse_notes(files: DataFrame, nested: bool | None = None) -> DataFrame:
    """``content_path, content`` to ``content_path, content, metadata, body``.

    Notes whose front matter has nested values go through the full YAML reader (``nested`` None);
    True sends all notes there, False none.
    """
    text = files.withColumn("_text", decode_markdown("content"))
    raw = front_matter("_text")
    # only front matter with indented or bracketed values needs the full YAML reader
    deep = F.coalesce(raw.rlike(r"(?m)^(?:[ \t]+\S|-[ \t])|:[ \t]*[\[{|>&*]"), F.lit(False))
    full = nested_metadata(F.when(deep, raw)) if nested is None else nested_metadata(raw)
    meta = F.when(deep, full).otherwise(flat_metadata(raw)) if nested is None else full if nested else flat_metadata(raw)
    return text.select("content_path", "content", meta.alias("metadata"), body_without_front_matter("_text").alias("body"))


def read_vault(spark: SparkSession, root: str, nested: bool | None = None) -> DataFrame:
    """Every ``*.md`` file below ``root``, keyed by its path relative to it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
        .load(root)
    )
    # Paths come back fully qualified, so the root is qualified the same way.
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(top).toString().rstrip("/")
    rel = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    return parse_notes(files.select(rel.alias("content_path"), "content"), nested)
