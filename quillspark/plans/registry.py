"""Name → query and name → SQL, filled by the query modules."""

from __future__ import annotations

from functools import wraps

from ..session import apply_safe_conf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register the decorated function under its own name, with its SQL when there is one.

    ``ints`` names result columns that are 32-bit in Spark and 64-bit in the SQL.
    """
    if sql is not None and ints:
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")

        @wraps(fn)
        def run(spark, sf_dir):
            apply_safe_conf(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add
