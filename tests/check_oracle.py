"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int, str)):
        return value
    return str(value)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols, rows = canon_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(rows)}", True
    rel = con.execute(sql)
    want_cols, want = canon_rows([d[0] for d in rel.description], rel.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}", False
    if len(rows) != len(want):
        extra = [r for r in rows if r not in set(want)][:2] if len(rows) < 50000 else []
        return f"row counts {len(rows)} != {len(want)} {str(extra)[:600]}", False
    for a, b in zip(rows, want):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return f"first difference {str(diff)[:900]} in {str(a)[:300]}", False
    return f"{len(rows)} rows equal", True


def main(argv):
    from quillspark import plans
    from quillspark.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = plans.all_oracles(), 0
    for name, fn in plans.all_queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            note, ok = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            note, ok = f"{type(exc).__name__}: {str(exc)[:1500]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} ({time.time() - t:.1f}s) {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
