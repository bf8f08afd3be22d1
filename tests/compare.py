"""Runs queries and their SQL over the same tables and says where they differ: python -m tests.compare DIR [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(value) if isinstance(value, list) else value


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def difference(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None where they agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, map(tuple, df.collect()))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = connection(sf_dir).execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want = rows(columns, cursor.fetchall())
    if got != want:
        return f"{got.total()} and {want.total()} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None if got else "no rows"


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            said = difference(session, sys.argv[1], query)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(query, "ok" if said is None else said[:900], f"{time.time() - began:.1f} s", flush=True)
