"""Holds queries against their SQL in DuckDB: python tests/oracle.py [sf dir] [names...]."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if isinstance(x, float) and x != x or x is None or x is pd.NaT or x is pd.NA:
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float) and x == int(x) if isinstance(x, float) and abs(x) < 1e15 else False:
            return int(x)
        return str(x) if isinstance(x, (pd.Timestamp,)) else x

    return sorted((tuple(one(v) for v in row) for row in df.astype(object).itertuples(index=False)), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def difference(spark, name: str, f, sql: str, sf: str) -> str | None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want, got = con.execute(sql).df(), f(spark, sf).toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)}, SQL has {sorted(want.columns)}"
    a, b = plain(got), plain(want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
        return f"{name}: {len(a)} rows, SQL has {len(b)}; {len(odd)} differ, as {odd[:2]}"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"), sys.argv[2:]
    spark, queries, sql = session(), entry.queries(), entry.oracle_sql()
    for n in names or [q for q in queries if not q.startswith(("op", "pipeline"))]:
        try:
            if n in sql:
                print(n, difference(spark, n, queries[n], sql[n], sf) or "equal", flush=True)
            else:
                print(n, queries[n](spark, sf).count(), "rows, no SQL", flush=True)
        except Exception as e:
            print(n, "FAILED", str(e).splitlines()[0][:300], flush=True)
