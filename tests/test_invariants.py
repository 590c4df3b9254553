"""What must hold on the largest given tables, whatever their rows."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.dedupe import keep_latest
from sluiceway.operators.merge import merge_partition
from sluiceway.operators.staging import stamp_partition, with_ingestion_meta
from sluiceway.sources.tables import PathTable

SF_DIR = "/root/testdata/sf0.1"
KEYS = ["l_orderkey", "l_linenumber"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(
        *KEYS, "l_shipdate", "l_extendedprice", "l_returnflag"
    )


def test_dedupe_leaves_every_key_once(lines):
    latest = keep_latest(lines, KEYS, ["l_shipdate"])
    counts = latest.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(*KEYS).alias("keys")
    ).first()
    keys = lines.select(*KEYS).distinct().count()
    assert counts.rows == counts.keys == keys


# A full outer join, and the search for hot keys before it.
@pytest.mark.parametrize("limits", [{}, {"hot_rows": 1000, "small_rows": 0}])
def test_merge_counts_other_partitions_and_rerun(spark, lines, tmp_path, limits):
    schema = T.StructType([*lines.schema.fields])
    schema.add("_ingest_ts", "timestamp").add("_run_id", "string").add("ds", "string")
    table = PathTable(str(tmp_path / "lines"), schema)
    held = lines.filter(F.col("l_returnflag") != "A")
    table.replace_partition(stamp_partition(with_ingestion_meta(held, "seed"), "2024-01-02"))
    table.replace_partition(stamp_partition(with_ingestion_meta(lines, "seed"), "2024-01-01"))

    def files(day):
        folder = Path(table.path) / f"ds={day}"
        return {f.name: f.read_bytes() for f in folder.glob("*.parquet")}

    before = files("2024-01-01")
    source = lines.filter(F.col("l_returnflag") != "R")

    def run(run_id):
        merge_partition(
            with_ingestion_meta(source, run_id).withColumn("ds", F.lit("2024-01-02")),
            table,
            KEYS,
            "2024-01-02",
            latest_by=["l_shipdate"],
            **limits,
        )
        landed = table.read_partition(spark, "2024-01-02")
        data = landed.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("n"))
        check = F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))
        return landed.count(), data.agg(check.alias("check")).first().check

    first = run("r1")
    added = source.select(*KEYS).distinct().join(held, KEYS, "left_anti").count()
    assert first[0] == held.count() + added
    assert run("r2") == first
    assert files("2024-01-01") == before
    runs = table.read_partition(spark, "2024-01-02").groupBy("_run_id").count().collect()
    assert {row._run_id for row in runs} == {"seed", "r2"}
