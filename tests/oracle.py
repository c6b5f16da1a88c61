"""Run a query and its SQL side by side and compare the rows exactly.

``python tests/oracle.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def family(dtype: str) -> str:
    d = dtype.lower()
    for family, names in {
        "int32": ("int", "integer"),
        "int64": ("bigint", "long"),
        "float": ("double",),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
    }.items():
        if d in names:
            return family
    return d


def compare(spark, con, root, fn, sql):
    """Return ``None`` if equal, else a description of the first difference."""
    df = fn(spark, root)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want_types = [str(d[1]) for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    types = {c: family(t) for c, t in df.dtypes}
    for c, t in zip(want_cols, want_types):
        if types[c] != family(t):
            return f"type of {c}: {types[c]} != {family(t)}"
    a, b = canonical(df.columns, got), canonical(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    db = connect(folder)
    for key, fn in entry.queries().items():
        if names and key not in names:
            continue
        sql = entry.oracle_sql().get(key)
        t = time.time()
        try:
            if sql is None:
                verdict = f"rows only: {len(fn(session, folder).collect())}"
            else:
                verdict = compare(session, db, folder, fn, sql) or "ok"
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{key:28s} {time.time() - t:6.2f}s {verdict}", flush=True)
