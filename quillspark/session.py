"""Session helpers: session defaults, the shared work folder, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is measured to fit both limits.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A union may claim that its inputs share one partitioning although adaptive
# execution has coalesced them differently; a grouping after it then sees parts
# of a key in two places. With this off, the grouping shuffles as it should.
SAFE_CONF = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC"}

_FALLBACK_DIRS: dict[str, str] = {}


def build_session(app_name: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **SAFE_CONF,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_safe_conf(spark: SparkSession) -> None:
    """Give a session that was built elsewhere the settings results depend on."""
    for key, value in SAFE_CONF.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _FALLBACK_DIRS:
        path = tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(path)
        _FALLBACK_DIRS[sc.applicationId] = path
    return _FALLBACK_DIRS[sc.applicationId]


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder for one run's written tables."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _row_bytes(df: DataFrame):
    """A cheap upper-side estimate of a row's width: the length of its JSON text."""
    return F.length(F.to_json(F.struct(*df.columns))).cast("long")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Measure ``df`` against the broadcast limits with one aggregate job."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast when the measured size allows, else leave it to the optimizer."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The lineage ends at the written table in the shared folder: nothing above it
    runs again, and a lost executor only rereads files.
    """
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
