"""Run queries and their SQL side by side: python -m tests.oracle [--sf DIR] [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def views(d):
    con = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if np.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, d, query, sql):
    """None if the results agree, else what differs."""
    df = query(spark, d)
    a = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = table(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if a[1] != b[1]:
        x, y = [r for r in a[1] if r not in set(b[1])], [r for r in b[1] if r not in set(a[1])]
        return f"{len(a[1])} rows against {len(b[1])}; only here {x[:3]}; only in SQL {y[:3]}"
    return None if a[1] or "--empty-ok" in sys.argv else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    d = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--")]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = views(d), 0
    for name, f in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in e.oracle_sql():
                why = compare(spark, con, d, f, e.oracle_sql()[name])
            else:
                why = None if f(spark, d).count() else "no rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += why is not None
        print(f"{name} {time.time() - t:.1f}s", "ok" if why is None else f"DIFFERS {why}", "" if name in e.oracle_sql() else "(no SQL)", flush=True)
    sys.exit(bad > 0)
