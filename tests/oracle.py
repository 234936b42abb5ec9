"""Spark and DuckDB side by side: python tests/oracle.py SF_DIR [NAME...]; also used by test_oracle.py."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def differences(df, con, sql: str) -> str:
    """What differs, or nothing."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} against {sorted(rel.columns)}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    if wrong := {c: (kinds[c], theirs[c]) for c in names if kinds[c] != theirs[c]}:
        return f"types {wrong}"
    order = [rel.columns.index(c) for c in names]
    key = lambda r: tuple((x is not None, x) for x in r)
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    if len(ours) != len(want):
        return f"{len(ours)} rows against {len(want)}"
    for a, b in zip(ours, want, strict=True):
        if not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1e-6) for x, y in zip(a, b, strict=True)):
            return f"{a} against {b}"
    return ""


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.config(map={"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = f(spark, sf)
            found = differences(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as x:
            found = f"ERROR {str(x)[:300]!r}"
        bad += bool(found) and not found.startswith("rows only")
        print(f"{time.time() - t:6.1f} {name}: {found or 'same'}"[:420], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
