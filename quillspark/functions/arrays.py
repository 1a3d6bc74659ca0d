"""Array expressions shared by the per-document folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 256


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    Lambdas are interpreted without common-subexpression elimination, so an
    expression written twice inside them would run twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of integers.

    Appending to an array inside a fold copies it, so one fold over n entries
    costs n². Two levels of folds over groups of 256 entries keep long arrays
    near-linear: first the group totals, then the entries inside each group.
    """

    def running(arr: Column, start: Column) -> Column:
        seed = F.struct(F.array().cast("array<bigint>").alias("out"), start.cast("bigint").alias("acc"))
        return F.aggregate(
            arr, seed,
            lambda s, x: F.struct(
                F.concat(s["out"], F.array(s["acc"])).alias("out"),
                (s["acc"] + x.cast("bigint")).alias("acc"),
            ),
            lambda s: s["out"],
        )

    def build(arr: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / F.lit(_GROUP)).cast("int"))
        totals = F.transform(
            groups,
            lambda g: F.aggregate(F.slice(arr, g * _GROUP + 1, _GROUP), F.lit(0).cast("bigint"),
                                  lambda a, x: a + x.cast("bigint")),
        )
        nested = F.transform(
            running(totals, F.lit(0)),
            lambda start, g: running(F.slice(arr, g * _GROUP + 1, _GROUP), start),
        )
        return F.when(F.size(arr) <= _GROUP, running(arr, F.lit(0))).otherwise(F.flatten(nested))

    return let(lengths, build)
