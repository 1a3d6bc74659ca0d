"""A training-data pipeline over ``documents``: five stages, each written and read again.

quality classifier -> language ID -> near-dedup by SimHash and then by shingle similarity -> suffix-array dedup -> best-fit packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm.common import table
from quillspark.session import apply_safe_conf, settle

STAGES = [
    ("quality", stages.keep_good),
    ("language", stages.keep_known_language),
    ("near_dedup", stages.keep_one_of_near_copies),
    ("repeats", stages.remove_repeats),
    ("packing", stages.pack_sequences),
]

# Trained models and packing have no counterpart in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_safe_conf(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
