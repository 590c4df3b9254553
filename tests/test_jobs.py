import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import run
from sluiceway.operators.quality import QualityError
from sluiceway.plans.jobs import CRM_USERS, JOBS, POS_TRANSACTIONS, WEB_EVENTS, run_job
from sluiceway.plans.metadata import ItemDef, RuleSpec, export_items, registry
from sluiceway.sources.tables import PathTable
from tests.conftest import rows

DS = "2024-06-02"


@pytest.fixture
def metadata(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta'")
    name = f"meta.items_{uuid.uuid4().hex}"
    export_items(spark, table=name, path=str(tmp_path / "items"))
    return name


def write_csv(tmp_path, lines):
    path = tmp_path / f"{uuid.uuid4().hex}.csv"
    path.write_text("\n".join(lines))
    return str(path)


WEB_HEADER = "event_id,user_id,ts,event_type,props"


def run_web(spark, metadata, tmp_path, folder, lines, **args):
    given = {
        "inputPath": write_csv(tmp_path, [WEB_HEADER, *lines]),
        "outputPath": folder,
        "ds": DS,
        "run_id": "r1",
    }
    results = run_job(spark, WEB_EVENTS, {**given, **args}, metadata)
    return results, PathTable(folder, WEB_EVENTS.output_schema).read(spark)


def test_rows_land_under_the_run_date(spark, metadata, tmp_path, folder):
    results, landed = run_web(
        spark,
        metadata,
        tmp_path,
        folder,
        ["e1,u1,2024-06-01 12:00:00,click,p", "e2,,not a date,view,", "e3,u3,,view,q"],
    )
    assert [r.ok for r in results] == [True]
    assert landed.columns == [
        "event_id", "user_id", "event_type", "ds", "props", "_ingest_ts", "_run_id"
    ]
    assert rows(landed.drop("_ingest_ts")) == [
        ("e1", "u1", "click", DS, "p", "r1"),
        ("e2", None, "view", DS, None, "r1"),
        ("e3", "u3", "view", DS, "q", "r1"),
    ]
    assert landed.select("_ingest_ts").distinct().count() == 1


def test_copies_in_one_file_reduce_to_the_latest(spark, metadata, tmp_path, folder):
    _, landed = run_web(
        spark,
        metadata,
        tmp_path,
        folder,
        ["e1,u1,2024-06-01,first,p", "e1,u1,2024-06-03,last,p", "e1,u1,2024-06-02,second,p"],
    )
    assert rows(landed, "event_id", "event_type") == [("e1", "last")]


def test_rerun_changes_only_the_audit_columns(spark, metadata, tmp_path, folder):
    lines = ["e1,u1,2024-06-01,a,p", "e2,u2,2024-06-01,b,q"]
    _, landed = run_web(spark, metadata, tmp_path, folder, lines)
    first = rows(landed)
    _, landed = run_web(spark, metadata, tmp_path, folder, lines, run_id="r2")
    second = rows(landed)
    assert [r[:5] for r in second] == [r[:5] for r in first]
    assert {r[6] for r in second} == {"r2"}
    assert all(b[5] > a[5] for a, b in zip(first, second))


def test_later_run_upserts_and_other_days_stay(spark, metadata, tmp_path, folder):
    run_web(spark, metadata, tmp_path, folder, ["e1,u,2024-06-01,a,p", "e2,u,2024-06-01,a,p"])
    run_web(spark, metadata, tmp_path, folder, ["e1,u,2024-06-01,z,p"], ds="2024-06-03")
    _, landed = run_web(
        spark,
        metadata,
        tmp_path,
        folder,
        ["e2,u,2024-06-01,b,p", "e3,u,2024-06-01,b,p"],
        run_id="r2",
    )
    assert rows(landed, "event_id", "event_type", "ds", "_run_id") == [
        ("e1", "a", DS, "r1"),
        ("e1", "z", "2024-06-03", "r1"),
        ("e2", "b", DS, "r2"),
        ("e3", "b", DS, "r2"),
    ]


def test_shut_gate_writes_nothing(spark, metadata, tmp_path, folder):
    with pytest.raises(QualityError, match=r"filled_ratio\(event_id\)>=0.999.*observed -> 0.5"):
        run_web(spark, metadata, tmp_path, folder, ["e1,u,2024-06-01,a,p", ",u,2024-06-01,a,p"])
    assert not (tmp_path / "table").exists()


def test_crm_gate_on_a_blank_email(spark, metadata, tmp_path, folder):
    """Nine of ten emails are filled and the rule asks for 98 percent."""
    lines = ["user_id,email,signup_date,age"]
    lines += [f"u{i},{'' if i == 6 else f'u{i}@example.org'},2024-01-0{i},30" for i in range(10)]
    args = {"inputPath": write_csv(tmp_path, lines), "outputPath": folder, "ds": DS}
    with pytest.raises(QualityError) as caught:
        run_job(spark, CRM_USERS, args, metadata)
    assert str(caught.value) == (
        "DQ failed: filled_ratio(email)>=0.98 details=Map(observed -> 0.9)"
    )


def test_pos_gate_on_a_file_in_another_order(spark, metadata, tmp_path, folder):
    """The fourth column is a time, so every amount is null and both rules fail."""
    lines = ["transaction_id,card,amount,timestamp,store,method"]
    lines += [f"{i},L{i},9.99,2024-06-01 12:00:00,S1,cash" for i in range(10)]
    args = {"inputPath": write_csv(tmp_path, lines), "outputPath": folder, "ds": DS}
    with pytest.raises(QualityError) as caught:
        run_job(spark, POS_TRANSACTIONS, args, metadata)
    assert str(caught.value) == (
        "DQ failed: value_ratio(amount gt 0.0)>=0.98 details=Map(observed -> 0.0); "
        "max_percentile(amount,p=0.999)<=5000.0 details=Map(approx_quantile -> NaN)"
    )


def test_pos_job_lands_typed_amounts(spark, metadata, tmp_path, folder):
    lines = ["transaction_id,user_id,store_id,amount,currency,timestamp"]
    lines += [f"t{i},u,s,{i + 0.5},EUR,2024-06-01 12:00:00" for i in range(3)]
    args = {"inputPath": write_csv(tmp_path, lines), "outputPath": folder, "ds": DS}
    run_job(spark, POS_TRANSACTIONS, args, metadata)
    landed = PathTable(folder, POS_TRANSACTIONS.output_schema).read(spark)
    assert rows(landed, "transaction_id", "amount", "ds") == [
        ("t0", 0.5, DS),
        ("t1", 1.5, DS),
        ("t2", 2.5, DS),
    ]


def test_keys_and_table_come_from_metadata(spark, tmp_path):
    location = tmp_path / "landed"
    spark.sql(
        "CREATE TABLE landed_users (user_id STRING, email STRING, country STRING, ds STRING,"
        " _ingest_ts TIMESTAMP, _run_id STRING) USING parquet PARTITIONED BY (ds)"
        f" LOCATION '{location}'"
    )
    item = ItemDef(
        "core", "crm", "crm_users", ("country", "user_id"),
        (RuleSpec("filled_ratio", {"column": "country", "min": "1"}),), "landed_users",
    )
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta'")
    name = f"meta.items_{uuid.uuid4().hex}"
    export_items(spark, [item], table=name, path=str(tmp_path / "items"))
    lines = ["user_id,email,country,created_at", "u1,a,FR,2024-01-01", "u1,b,DE,2024-01-01"]
    run_job(spark, CRM_USERS, {"inputPath": write_csv(tmp_path, lines), "ds": DS}, name)
    landed = spark.table("landed_users")
    assert rows(landed, "user_id", "email", "country") == [("u1", "a", "FR"), ("u1", "b", "DE")]
    assert landed.select(F.max("ds").alias("ds")).first().ds == DS


def test_a_job_may_read_several_inputs(spark, metadata, tmp_path, folder):
    users = write_csv(tmp_path, ["user_id,country", "u1,FR", "u2,DE"])
    mails = write_csv(tmp_path, ["user_id,email", "u1,a@b.c", "u2,d@e.f"])

    def read(session, args):
        return {
            "users": session.read.option("header", "true").csv(args["users"]),
            "mails": session.read.option("header", "true").csv(args["mails"]),
        }

    def transform(inputs, context):
        joined = inputs["users"].join(inputs["mails"], "user_id")
        return joined.withColumn("ds", F.lit(context.ds).cast("date"))

    job = replace(CRM_USERS, read_sources=read, transform=transform)
    args = {"users": users, "mails": mails, "outputPath": folder, "ds": DS}
    run_job(spark, job, args, metadata)
    landed = PathTable(folder, job.output_schema).read(spark)
    assert rows(landed, "user_id", "email", "country", "ds") == [
        ("u1", "a@b.c", "FR", DS),
        ("u2", "d@e.f", "DE", DS),
    ]


def test_submitting_from_the_command_line(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta'")
    name = f"meta.items_{uuid.uuid4().hex}"
    landing = f"landing_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {landing} (event_id STRING, user_id STRING, event_type STRING,"
        " props STRING, _ingest_ts TIMESTAMP, _run_id STRING, ds STRING)"
        f" USING parquet PARTITIONED BY (ds) LOCATION '{tmp_path}/landed'"
    )
    run.main(["export", "--metadataTable", name])
    path = write_csv(tmp_path, [WEB_HEADER, "e1,u1,2024-06-01,click,p"])
    run.main(
        ["web_events", "--inputPath", path, "--ds", DS, "--run_id", "r9"]
        + ["--outputTable", landing, "--metadataTable", name]
    )
    assert rows(spark.table(landing), "event_id", "props", "_run_id", "ds") == [
        ("e1", "p", "r9", DS)
    ]
    with pytest.raises(SystemExit):
        run.main(["unknown_job"])


def test_default_input_path_and_job_identities(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND.*/mnt/data/crm_users.csv"):
        CRM_USERS.read_sources(spark, {})
    assert {name: (j.name, j.domain, j.group_name) for name, j in JOBS.items()} == {
        "crm_users": ("CRMUsersJob", "core", "crm"),
        "pos_transactions": ("POSTransactionsJob", "payments", "pos"),
        "web_events": ("WebEventsJob", "analytics", "web"),
    }
    assert {(j.domain, j.group_name, j.item_name) for j in JOBS.values()} == {
        (i.domain, i.group_name, i.item_name) for i in registry()
    }
