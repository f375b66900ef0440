"""Runs registered queries in Spark and their oracle SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from webposture.plans.fixtures import TABLES


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both sides return the same rows under the same column names and types."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = Counter(tuple(_cell(row[n]) for n in names) for row in df.collect())
    relation = con.sql(sql)
    if names != sorted(relation.columns):
        return f"columns {names} / {sorted(relation.columns)}"
    wide = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    types = dict(zip(relation.columns, [wide.get(str(t), str(t)) for t in relation.types]))
    wrong = {n: (t, types[n]) for n, t in df.dtypes if types[n] != t}
    if wrong:
        return f"types {wrong}"
    at = [relation.columns.index(n) for n in names]
    right = Counter(tuple(_cell(row[i]) for i in at) for row in relation.fetchall())
    if left != right:
        return f"rows {left.total()} / {right.total()}, only Spark {list((left - right).items())[:3]}, only SQL {list((right - left).items())[:3]}"
    return None if left else "empty"


if __name__ == "__main__":
    import __spark_entry__ as driver

    spark, sf_dir = session(), sys.argv[1]
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = driver.oracle_sql()
    for name, query in driver.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begun = time.time()
        try:
            result = difference(spark, con, query, oracles[name], sf_dir) if name in oracles else "no oracle"
        except Exception as error:
            result = f"error {str(error)[:600]}"
        print(f"{name}: {result or 'equal'} ({time.time() - begun:.1f}s)", flush=True)
