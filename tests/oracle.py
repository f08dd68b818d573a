"""Compare queries with their oracles: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, name: str, run, sql: str, sf_dir: str, con=None) -> str:
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = (con or duck(sf_dir)).execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows against {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b))]
    return f"{name}: {len(wrong)} of {len(got)} rows differ, first {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            print(differences(spark, name, queries[name], oracles[name], sys.argv[1]) or f"{name}: same", round(time.time() - began, 1), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: {type(e).__name__} {str(e)[:600]}", flush=True)
