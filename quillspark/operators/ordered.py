"""Ordered scans inside keys of any size.

A plain window keeps all rows of a key in one task, which fails when one key
holds a large part of the table. Here a key is cut into blocks of its ordinal;
the window runs per block, and one small row per block carries the state on.
Only keys that reach past their first block need that second step. A filter on
the ordinal, which a Parquet scan answers from its statistics, tells whether
there are any; when there are none the plan is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _block(ordinal: str, size: int) -> Column:
    return F.floor(F.col(ordinal) / F.lit(size)).cast("bigint")


def _carried(df: DataFrame, long_keys: DataFrame, keys: list[str], ordinal: str, size: int,
             summary: Column, carry) -> DataFrame:
    """One row per (key, block) of the long keys with the state left by earlier blocks."""
    per_block = (
        df.join(long_keys, keys, "left_semi")
        .groupBy(*keys, _block(ordinal, size).alias("_block")).agg(summary.alias("_state"))
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, "_block", carry(F.col("_state")).over(before).alias("_carry"))


def _scan(df: DataFrame, keys: list[str], ordinal: str, value: Column, block: int, source: DataFrame | None,
          here, rows: tuple[int, int], summary: Column, carry, combine) -> DataFrame:
    beyond = (F.col(ordinal) >= block) | (F.col(ordinal) < 0)
    long_keys = (df if source is None else source).where(beyond).select(*keys).distinct()
    valued = df.withColumn("_value", value).withColumn("_block", _block(ordinal, block))
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(*rows)
    if not long_keys.limit(1).count():
        inside = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(*rows)
        return valued.withColumn("_out", combine(here(F.col("_value")).over(inside), None)).drop("_value", "_block")
    carried = _carried(valued.select(*keys, ordinal, "_value"), long_keys, keys, ordinal, block, summary, carry)
    return (
        valued.withColumn("_here", here(F.col("_value")).over(inside))
        .join(carried, [*keys, "_block"], "left")
        .withColumn("_out", combine(F.col("_here"), F.col("_carry")))
        .drop("_value", "_block", "_here", "_carry")
    )


def last_before(df: DataFrame, keys: list[str], ordinal: str, value: Column, out: str,
                block: int = BLOCK, source: DataFrame | None = None) -> DataFrame:
    """Add the last non-null ``value`` of the rows before each row of its key.

    ``source`` may name a stored table with the same keys and ordinals in which to
    look for long keys, when ``df`` itself is costly to compute.
    """
    return _scan(
        df, keys, ordinal, value, block, source,
        here=lambda v: F.last(v, ignorenulls=True), rows=(Window.unboundedPreceding, -1),
        summary=F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(ordinal))),
        carry=lambda state: F.last(state, ignorenulls=True),
        combine=lambda here, carry: here if carry is None else F.coalesce(here, carry),
    ).withColumnRenamed("_out", out)


def running_sum(df: DataFrame, keys: list[str], ordinal: str, value: Column, out: str,
                block: int = BLOCK, source: DataFrame | None = None) -> DataFrame:
    """Add the sum of ``value`` over a key's rows up to and including each row."""
    return _scan(
        df, keys, ordinal, value.cast("bigint"), block, source,
        here=F.sum, rows=(Window.unboundedPreceding, 0), summary=F.sum("_value"), carry=F.sum,
        combine=lambda here, carry: here if carry is None else here + F.coalesce(carry, F.lit(0)),
    ).withColumnRenamed("_out", out)


def global_rank(df: DataFrame, ordinal: str, out: str, block: int = BLOCK, descending: bool = False) -> DataFrame:
    """Number all rows from 1 by a unique integer ordinal, without one task seeing them all."""
    blocked = df.withColumn("_block", _block(ordinal, block))

    def by(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = Window.partitionBy("_block").orderBy(by(ordinal))
    before = Window.orderBy(by("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of 65,536: small enough to number in a single task.
    starts = (
        blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        blocked.withColumn("_nth", F.row_number().over(inside)).join(starts, "_block")
        .withColumn(out, (F.col("_start") + F.col("_nth")).cast("bigint")).drop("_block", "_nth", "_start")
    )
