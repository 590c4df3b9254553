"""Submit a job or the metadata export.

    spark-submit run.py export
    spark-submit run.py crm_users --inputPath /data/crm_users.csv --ds 2025-08-08

With --metadataPath the definitions are files there, and no catalog is needed.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from sluiceway import JOBS, export_items, run_job
from sluiceway.plans.metadata import METADATA_TABLE, files_table


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(
        description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    parser.add_argument("task", choices=["export", *JOBS])
    parser.add_argument("--metadataTable", default=METADATA_TABLE)
    parser.add_argument("--metadataPath")
    for name in ("inputPath", "ds", "run_id", "outputPath", "outputTable"):
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    task, table = given.pop("task"), given.pop("metadataTable")
    path = given.pop("metadataPath")
    if task == "export":
        spark = SparkSession.builder.appName("ExportMetadata").getOrCreate()
        export_items(spark, table=table if path is None else None, path=path)
        return
    job = JOBS[task]
    spark = SparkSession.builder.appName(job.name).getOrCreate()
    args = {name: value for name, value in given.items() if value is not None}
    run_job(spark, job, args, table if path is None else files_table(path))


if __name__ == "__main__":
    main()
