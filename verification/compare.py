"""Run queries against their SQL: ``python -m verification.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from verification.oracles import ORACLES
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """Say how a query differs from its SQL, or None if it does not."""
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    expected = connection.sql(ORACLES[name]).to_arrow_table()
    frame = QUERIES[name](spark, sf_dir)
    actual = frame.collect()
    if sorted(frame.columns) != sorted(expected.column_names):
        return f"columns {sorted(frame.columns)} != {sorted(expected.column_names)}"
    columns = [column.to_pylist() for column in expected.columns]
    wanted = _rows(expected.column_names, list(zip(*columns)))
    got = _rows(frame.columns, actual)
    if got == wanted:
        return None
    return (
        f"{got.total()} rows, expected {wanted.total()};"
        f" surplus {list((got - wanted).items())[:3]}; missing {list((wanted - got).items())[:3]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        started = time.time()
        problem = differences(spark, sf_dir, name)
        failed += problem is not None
        print(f"{name}: {problem or 'equal'} ({time.time() - started:.1f}s)", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
