"""Time this engine against the plan shape it replaces, on the same tables and session.

The plain shape evaluates each rule on its own and merges by one full outer join, both from
the engine's own parts, so that plans are compared and nothing else; its merge is written to
a fresh folder, which is the cheapest form it could take. ``BENCH_COPIES`` repeats the orders that many times
under new keys. Prints one JSON line: seconds per flow, [plain, engine].
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sluiceway.operators.dedupe import keep_latest  # noqa: E402
from sluiceway.operators.merge import merge_partition  # noqa: E402
from sluiceway.operators.quality import check, report  # noqa: E402
from sluiceway.operators.rules import FilledRatio, MaxPercentile, ValueRatio  # noqa: E402
from sluiceway.operators.staging import with_ingestion_meta  # noqa: E402
from sluiceway.plans.jobs import POS_TRANSACTIONS, POS_TRANSACTIONS_SOURCE  # noqa: E402
from sluiceway.sources.csv import read_csv  # noqa: E402
from sluiceway.sources.tables import PathTable  # noqa: E402
from sluiceway.workspace import fresh_path  # noqa: E402
from verification.queries import _context  # noqa: E402
from verification.stand_ins import DS, as_csv, given, pos_source  # noqa: E402

KEY = "transaction_id"
RULES = [
    FilledRatio(KEY, 0.999),
    ValueRatio("amount", "gt", 0.0, 0.98),
    MaxPercentile("amount", 0.999, 500000.0),
]


def plain_gate(df: DataFrame) -> None:
    """One evaluation, and so one scan, per rule."""
    for rule in RULES:
        assert all(result.ok for result in check(df, [rule]))


def plain_merge(df: DataFrame, current: DataFrame, path: str) -> None:
    """The engine's own dedupe, then one ordinary full outer join."""
    source = keep_latest(df, [KEY], ["_ingest_ts"]).drop("ds").withColumn("given", F.lit(True))
    held = current.drop("ds")
    joined = source.alias("s").join(held.alias("t"), KEY, "full_outer")
    rest = [c for c in held.columns if c != KEY]
    newest = (F.when(F.col("given"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest)
    joined.select(KEY, *newest).write.parquet(path)


def best(action, runs: int) -> float:
    seconds = []
    for _ in range(runs):
        started = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - started)
    return round(min(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = pos_source(given(spark, sf_dir, "orders")).crossJoin(
        F.broadcast(spark.range(copies).withColumnRenamed("id", "copy"))
    )
    source = source.withColumn(KEY, F.concat_ws("-", KEY, "copy")).drop("copy")
    raw = read_csv(spark, as_csv(source.repartition(int(cpus)), "plain"), POS_TRANSACTIONS_SOURCE)
    rows = POS_TRANSACTIONS.transform({"raw": raw}, _context(POS_TRANSACTIONS))
    staged = with_ingestion_meta(rows, "run-1")
    table = PathTable(fresh_path(spark, "plain-table"), POS_TRANSACTIONS.output_schema)

    def engine_merge() -> None:
        merge_partition(staged, table, [KEY], DS, latest_by=["_ingest_ts", "ds"], stamp=True)

    engine_merge()
    current = PathTable(fresh_path(spark, "plain-held"), table.schema)
    current.replace_partition(table.read(spark))
    held = current.read_partition(spark, DS)

    def plain_job() -> None:
        plain_gate(rows)
        plain_merge(staged, held, fresh_path(spark, "plain-out"))

    def engine_job() -> None:
        check(rows, RULES)
        engine_merge()

    seconds = {
        "gate": [
            best(lambda: plain_gate(rows), runs),
            best(lambda: check(rows, RULES), runs),
        ],
        "percentile_value": [
            best(lambda: rows.approxQuantile("amount", [0.999], 1e-6), runs),
            best(lambda: report(rows, RULES[2:]).collect(), runs),
        ],
        "dedupe_and_merge": [
            best(lambda: plain_merge(staged, held, fresh_path(spark, "plain-out")), runs),
            best(engine_merge, runs),
        ],
        "gate_and_merge": [best(plain_job, runs), best(engine_job, runs)],
    }
    spark.stop()
    print(json.dumps({"rows": copies * 1.5e6 * float(sf_dir.rsplit("sf", 1)[-1]), **seconds}))


if __name__ == "__main__":
    main()
