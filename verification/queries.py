"""One query per operator, run over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.context import RunContext
from sluiceway.functions.columns import event_date
from sluiceway.operators.dedupe import keep_latest
from sluiceway.operators.merge import (
    merge_into_files,
    merge_partition,
    merge_partitions,
    overwrite_partition,
    overwrite_where,
)
from sluiceway.operators.profiles import (
    check_landed,
    landed_quantiles,
    profile_table,
    refresh_profiles,
)
from sluiceway.operators.quality import QualityError, check, gate, report
from sluiceway.operators.rules import FilledRatio, MalformedRatio, MaxPercentile, ValueRatio
from sluiceway.operators.staging import only_partition, stamp_partition, with_ingestion_meta
from sluiceway.plans.jobs import (
    CRM_USERS,
    CRM_USERS_SOURCE,
    POS_TRANSACTIONS,
    POS_TRANSACTIONS_SOURCE,
    WEB_EVENTS,
    WEB_EVENTS_SOURCE,
    Job,
    run_job,
)
from sluiceway.plans.metadata import ITEM_SCHEMA, ItemDef, RuleSpec, load_item, registry, rule_rows
from sluiceway.sources.csv import read_csv
from sluiceway.sources.tables import FILE, CatalogTable, PathTable
from sluiceway.workspace import fresh_path
from verification.stand_ins import (
    DS,
    as_csv,
    crm_source,
    database,
    given,
    metadata_table,
    partitioned_table,
    pos_source,
    spoiled_events,
    text,
    web_source,
)

Query = Callable[[SparkSession, str], DataFrame]


def _context(job: Job) -> RunContext:
    return RunContext(job.domain, job.group_name, job.item_name, run_id="run-1", ds=DS)


def _transformed(job: Job, raw: DataFrame) -> DataFrame:
    shaped = job.transform({"raw": raw}, _context(job))
    return shaped.withColumn("ds", text("ds"))


# Projections


def web_events_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(WEB_EVENTS, web_source(given(spark, sf_dir, "events")))


def pos_transactions_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(POS_TRANSACTIONS, pos_source(given(spark, sf_dir, "orders")))


def crm_users_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(CRM_USERS, crm_source(given(spark, sf_dir, "customer")))


def event_date_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    date_text = (
        F.when(kind == "error", "34")
        .when(kind == "click", "")
        .when(kind == "purchase", "2024-02-30")
        .when(kind == "view", text("ts"))
    )
    events = given(spark, sf_dir, "events").select(
        "event_id", "event_type", date_text.alias("date_text")
    )
    return events.select("event_id", text(event_date("date_text", DS)).alias("ds"))


def ingestion_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = with_ingestion_meta(given(spark, sf_dir, "events"), "run-1")
    stamped = stamp_partition(staged, DS)
    return stamped.select(
        "event_id", "_run_id", "ds", F.col("_ingest_ts").isNotNull().alias("has_ingest_ts")
    )


def single_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _transformed(WEB_EVENTS, web_source(given(spark, sf_dir, "events")))
    return only_partition(landed, "2024-01-05")


# Sources


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = web_source(given(spark, sf_dir, "events"))
    return read_csv(spark, as_csv(source, "events-csv"), WEB_EVENTS_SOURCE)


def csv_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names, a text where a number is due, and one column too many."""
    orders = given(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "none")
        .otherwise(text("o_totalprice"))
        .alias("price_text"),
        "o_orderstatus",
        F.lit("2024-01-01").alias("day"),
        F.lit("surplus").alias("surplus"),
    )
    return read_csv(spark, as_csv(orders, "orders-csv"), POS_TRANSACTIONS_SOURCE)


def csv_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = given(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "null")
        .when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name"))
        .alias("c_name"),
    )
    read = read_csv(spark, as_csv(customer, "customer-csv"), CRM_USERS_SOURCE)
    return read.select(
        "user_id",
        "email",
        F.col("country").isNull().alias("country_is_null"),
        F.col("created_at").isNull().alias("created_at_is_null"),
    )


def csv_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too few columns, too many, or a word for a number; and a rule on their share."""
    kind = F.col("event_type")
    fields = [text("event_id"), F.when(kind == "click", "none").otherwise(text("user_id")), kind, text(F.to_date("ts"))]
    line = (
        F.when(kind == "error", F.concat_ws(",", *fields[:2]))
        .when(kind == "signup", F.concat_ws(",", *fields, F.lit("surplus")))
        .otherwise(F.concat_ws(",", *fields))
    )
    # Files of text, each with a header first.
    path = fresh_path(spark, "events-lines")
    lines = given(spark, sf_dir, "events").select(F.to_date("ts").alias("file"), F.lit(1).alias("at"), line.alias("line"))
    headers = lines.select("file").distinct().select("file", F.lit(0).alias("at"), F.lit("event_id,user_id,event_type,day").alias("line"))
    every = lines.unionByName(headers).repartition("file").sortWithinPartitions("file", "at")
    every.select("file", "line").write.partitionBy("file").text(path)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, day string")
    read = read_csv(spark, f"{path}/*", schema, malformed="line")
    few, some = check(read, [MalformedRatio("line", 0.01), MalformedRatio("line", 1.0)])
    return read.select(
        *(text(c).alias(c) for c in read.columns), F.lit(few.observed).alias("share"), F.lit(few.ok).alias("few_ok"), F.lit(some.ok).alias("some_ok")
    )


# Quality rules


def dq_filled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spoiled_events(given(spark, sf_dir, "events"))
    return report(
        events,
        [
            FilledRatio("event_id", 0.999),
            FilledRatio("label", 0.75),
            FilledRatio("score", 0.5),
            FilledRatio("actor", 0.85),
        ],
    )


def dq_value_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spoiled_events(given(spark, sf_dir, "events"))
    ops = ("gt", "gte", "lt", "lte", "eq", "neq")
    return report(events, [ValueRatio("score", op, 50.0, 0.25) for op in ops])


def dq_max_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spoiled_events(given(spark, sf_dir, "events"))
    lineitem = given(spark, sf_dir, "lineitem")
    return report(
        events,
        [
            MaxPercentile("score", 0.5, 40.0),
            MaxPercentile("score", 0.9, 40.0),
            MaxPercentile("score", 0.999, 1000.0),
            MaxPercentile("score", 1.0, 100.0),
        ],
    ).unionByName(
        report(
            lineitem,
            [
                MaxPercentile("l_extendedprice", 0.25, 50000.0),
                MaxPercentile("l_extendedprice", 0.999, 50000.0),
                MaxPercentile("l_linenumber", 0.75, 6.0),
            ],
        )
    )


def dq_landed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all days of a table, from their profiles; one day is corrected and profiled again."""
    events = spoiled_events(given(spark, sf_dir, "events"))
    day = text(F.to_date("ts"))
    table = _path_table(spark, "event_id bigint, score double, actor bigint")
    table.replace_partition(events.select("event_id", "score", "actor", day.alias("ds")))
    profiles = profile_table(fresh_path(spark, "profiles"), table)
    profiled = len(refresh_profiles(spark, table, profiles, ["score", "actor"]))
    corrected = table.read(spark).filter("ds = '2024-01-05'").withColumn("score", F.col("score") + 1000.0)
    merge_partition(corrected, table, ["event_id"], "2024-01-05")
    rules = [
        MaxPercentile("score", 0.5, 40.0),
        MaxPercentile("score", 0.9, 2000.0),
        MaxPercentile("score", 0.25, 1.0),
        MaxPercentile("score", 1.0, 100.0),
        MaxPercentile("actor", 0.75, 1e9),
    ]
    again = len(refresh_profiles(spark, table, profiles, ["score", "actor"]))
    results = check_landed(spark, table, profiles, rules)
    exact = landed_quantiles(spark, table, rules, results)
    rows = [
        (r.rule.name, r.ok, r.numbers, q, r.low <= q <= r.high, profiled, again)
        for r, q in zip(results, exact)
    ]
    names = "rule string, ok boolean, numbers long, observed double, bracketed boolean, profiled int, again int"
    return spark.createDataFrame(rows, names)


def dq_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over whole texts and their lengths, one language's texts blanked."""
    documents = given(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "de", F.repeat(F.lit(" "), 3)).otherwise(F.col("text")).alias(
            "text"
        ),
        F.length("text").alias("length"),
        F.when(F.col("lang") != "fr", text("n_chars")).alias("n_chars"),
    )
    return report(
        documents,
        [
            FilledRatio("text", 0.5),
            ValueRatio("length", "gte", 100.0, 0.9),
            ValueRatio("n_chars", "lt", 5000.0, 0.25),
            MaxPercentile("length", 0.5, 1000.0),
            MaxPercentile("length", 0.999, 1000000.0),
        ],
    )


def _spoiled_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The jobs' transformed rows, a fifth of the emails blank and a third of the amounts NaN."""
    customer, orders = given(spark, sf_dir, "customer"), given(spark, sf_dir, "orders")
    blank = customer.withColumn(
        "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_name"))
    )
    nan = orders.withColumn(
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(
            F.col("o_totalprice")
        ),
    )
    return {
        "crm_users": _transformed(CRM_USERS, crm_source(blank)),
        "pos_transactions": _transformed(POS_TRANSACTIONS, pos_source(nan)),
        "web_events": _transformed(WEB_EVENTS, web_source(given(spark, sf_dir, "events"))),
    }


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipped rule, read back from the metadata table and applied to its item."""
    table = metadata_table(spark)
    frames = _spoiled_sources(spark, sf_dir)
    combined = None
    for job in (CRM_USERS, POS_TRANSACTIONS, WEB_EVENTS):
        item = load_item(spark, job.domain, job.item_name, table)
        outcome = report(frames[job.item_name], item.rules()).select(
            F.lit(job.item_name).alias("item"), "rule", "rule_type", "observed", "ok"
        )
        combined = outcome if combined is None else combined.unionByName(outcome)
    return combined


def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate reports when it does not raise."""
    frames = _spoiled_sources(spark, sf_dir)
    outcomes = [
        (item.item_name, result.name, result.observed, result.ok)
        for item in registry()
        for result in gate(frames[item.item_name], item.rules(), fail_fast=False)
        if not result.ok
    ]
    return spark.createDataFrame(
        outcomes, "item string, failed_rule string, observed double, ok boolean"
    )


def metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested item definitions derived from the data, through the catalog, one row per rule.

    Each event type becomes an item whose rules ask for its own observed extent.
    """
    params = F.create_map(
        F.lit("column"), F.lit("value"), F.lit("p"), F.lit("1.0"),
        F.lit("max"), text(F.max("user_id")),
    )
    filled = F.create_map(F.lit("column"), F.lit("props"), F.lit("min"), F.lit("0.98"))
    rules = F.array(
        F.struct(F.lit("filled_ratio").alias("ruleType"), filled.alias("params")),
        F.struct(F.lit("max_percentile").alias("ruleType"), params.alias("params")),
    )
    items = (
        given(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("itemName"))
        .agg(rules.alias("dqRules"))
        .select(
            F.lit("analytics").alias("domain"),
            F.lit("web").alias("groupName"),
            "itemName",
            F.array(F.lit("event_id")).alias("keyColumns"),
            "dqRules",
            F.concat(F.lit("silver."), "itemName").alias("outputTable"),
        )
    )
    database(spark, "meta")
    path = fresh_path(spark, "derived-items")
    name = f"meta.derived_{path.rsplit('-', 1)[1]}"
    items.write.option("path", path).format("parquet").saveAsTable(name)
    landed = spark.table(name)
    return rule_rows(landed.to(ITEM_SCHEMA)).select(
        "domain", "groupName", "itemName", "outputTable", "ruleType", "column", "min", "p", "max"
    )


# Dedupe


def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type"
    )
    return keep_latest(events, ["user_id"], ["ts"]).select("user_id", "event_id", "event_type")


def dedupe_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties on the ship date fall to the other columns, in their order."""
    lines = given(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"
    )
    return keep_latest(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


def dedupe_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key are one group, and a missing order value ranks last."""
    events = spoiled_events(given(spark, sf_dir, "events")).select(
        "actor", "event_id", F.nanvl("score", F.lit(None)).alias("score")
    )
    return keep_latest(events, ["actor"], ["score"]).withColumn("actor", text("actor"))


# Partitioned tables

_LANDED = "event_id string, user_id string, event_type string, props string"


def _landed(events: DataFrame) -> DataFrame:
    """Events with their day; event 0 has no key."""
    return events.select(
        text(F.nullif(F.col("event_id"), F.lit(0))).alias("event_id"),
        text("user_id").alias("user_id"),
        "event_type",
        "props",
        text(F.to_date("ts")).alias("ds"),
    )


def _path_table(spark: SparkSession, ddl: str) -> PathTable:
    schema = T.StructType.fromDDL(f"{ddl}, ds string")
    return PathTable(fresh_path(spark, "landed"), schema)


def overwrite_one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landed(given(spark, sf_dir, "events"))
    table = _path_table(spark, _LANDED)
    table.replace_partition(landed)
    fresh = landed.filter(F.col("event_type") != "error").withColumn("props", F.lit("fresh"))
    overwrite_partition(fresh, table, "2024-01-05")
    return table.read(spark)


def overwrite_catalog_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _landed(given(spark, sf_dir, "events"))
    table = CatalogTable(partitioned_table(spark, _LANDED))
    table.replace_partition(landed)
    fresh = landed.filter(F.col("event_type") != "error").withColumn("props", F.lit("fresh"))
    overwrite_partition(fresh.select("event_id", "ds", "props", "event_type", "user_id"),
                        table, "2024-01-05")
    return table.read(spark)


def _seed_and_source(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old rows under two days, and newer rows that overlap them in part."""
    before = stamp_partition(landed, "2024-01-31")
    held = stamp_partition(landed.filter(F.col("event_type") != "signup"), DS)
    seed = before.unionByName(held).withColumns(
        {"event_type": F.lit("old"), "note": F.lit("first")}
    )
    source = stamp_partition(landed.filter(F.col("event_type") != "view"), DS)
    return seed, source


def _merged(table, spark: SparkSession, sf_dir: str, runs: int) -> DataFrame:
    seed, source = _seed_and_source(_landed(given(spark, sf_dir, "events")))
    table.replace_partition(seed)
    for _ in range(runs):
        merge_partition(source, table, ["event_id"], DS)
    return table.read(spark)


def merge_path_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(_path_table(spark, f"{_LANDED}, note string"), spark, sf_dir, runs=1)


def merge_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(_path_table(spark, f"{_LANDED}, note string"), spark, sf_dir, runs=2)


def merge_catalog_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = partitioned_table(spark, f"{_LANDED}, note string")
    return _merged(CatalogTable(name), spark, sf_dir, runs=1)


def merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a table bucketed by key, whose rows are merged where they lie."""
    name = partitioned_table(spark, f"{_LANDED}, note string", "CLUSTERED BY (event_id) INTO 8 BUCKETS")
    return _merged(CatalogTable(name), spark, sf_dir, runs=2)


def merge_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two key columns, null in some rows; the held rows repeat keys, the source lacks a column."""
    lines = given(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    lines = lines.select("l_orderkey", number.alias("line"), F.col("l_quantity").alias("quantity"), "l_shipdate")
    table = _path_table(spark, "l_orderkey bigint, line int, quantity double, l_shipdate string")
    table.replace_partition(stamp_partition(lines.withColumn("l_shipdate", text("l_shipdate")), DS))
    known = lines.filter("quantity > 25").select("l_orderkey", "line", (-F.col("quantity")).alias("quantity"))
    new = known.withColumn("l_orderkey", -F.col("l_orderkey") - 1)
    source = stamp_partition(known.unionByName(new), DS)
    merge_partition(source, table, ["l_orderkey", "line"], DS, latest_by=["quantity"])
    return table.read(spark).withColumn("line", text("line"))


def merge_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held rows repeat their keys, and a fifth of them share the null key."""
    events = spoiled_events(given(spark, sf_dir, "events"))
    table = _path_table(spark, "actor bigint, event_id bigint, label string, tag string")
    held = events.select("actor", "event_id", "label", F.lit("held").alias("tag"))
    table.replace_partition(stamp_partition(held, DS))
    known = events.select("actor", F.lit("updated").alias("label"), F.lit("run").alias("tag"))
    new = known.withColumn("actor", -F.col("actor") - 1).withColumn("label", F.lit("added"))
    merge_partition(
        stamp_partition(known.unionByName(new), DS),
        table,
        ["actor"],
        DS,
        latest_by=["tag"],
        hot_rows=held.count() // 8,
        small_rows=0,
    )
    return table.read(spark).withColumns({"actor": text("actor"), "event_id": text("event_id")})


def merge_few_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day's events, corrected, and their copies under new keys, against all events."""
    events = given(spark, sf_dir, "events")
    table = _path_table(spark, "event_id bigint, event_type string, value double")
    held = events.select("event_id", "event_type", "value")
    table.replace_partition(stamp_partition(held, DS))
    day = events.filter(F.to_date("ts") == F.lit("2024-01-05")).select("event_id", "value")
    corrected = day.withColumn("value", -F.col("value"))
    copied = day.withColumn("event_id", -F.col("event_id") - 1)
    merge_partition(
        stamp_partition(corrected.unionByName(copied), DS),
        table,
        ["event_id"],
        DS,
        hot_rows=held.count() // 8,
    )
    return table.read(spark)


def merge_touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corrections, into files by day; says how many of these were rewritten."""
    events = given(spark, sf_dir, "events")
    table = _path_table(spark, "event_id bigint, event_type string, value double")
    held = events.repartition(16, F.to_date("ts")).select("event_id", "event_type", "value")
    table.replace_partition(stamp_partition(held, DS))
    before = _files_of(table, spark)
    day = events.filter(F.to_date("ts") == F.lit("2024-01-05")).select("event_id", "value")
    corrected = day.withColumn("value", -F.col("value"))
    copied = day.withColumn("event_id", -F.col("event_id") - 1)
    merge_into_files(stamp_partition(corrected.unionByName(copied), DS), table, ["event_id"], DS)
    gone = before.join(_files_of(table, spark), "file", "left_anti").count()
    return table.read(spark).withColumn("files_rewritten", F.lit(gone))


def _files_of(table, spark: SparkSession) -> DataFrame:
    held = table.read_with_files(spark).select(F.col(FILE).alias("file")).distinct()
    return spark.createDataFrame(held.toArrow())  # the names as they are now


def overwrite_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of some days, across their partitions, give way to one row a user."""
    landed = _landed(given(spark, sf_dir, "events"))
    table = CatalogTable(partitioned_table(spark, _LANDED))
    table.replace_partition(landed)
    meets = "event_type = 'error' and ds between '2024-01-03' and '2024-01-07'"
    users = landed.filter(meets).groupBy("user_id").agg(F.min("ds").alias("ds"), F.min("event_id").alias("event_id"))
    fresh = users.withColumns({"event_type": F.lit("error"), "props": F.lit("fresh")})
    overwrite_where(fresh, table, meets)
    return table.read(spark)


def merge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of several days and rows of a new one, in one run over a table of all days."""
    landed = _landed(given(spark, sf_dir, "events"))
    table = CatalogTable(partitioned_table(spark, f"{_LANDED}, note string"))
    table.replace_partition(landed.withColumns({"event_type": F.lit("old"), "note": F.lit("first")}))
    some = landed.filter(F.col("ds").between("2024-01-03", "2024-01-07") & (F.col("event_type") != "view"))
    fresh = landed.filter(F.col("ds") == "2024-01-05").withColumn("ds", F.lit("2025-01-01"))
    merge_partitions(some.unionByName(fresh), table, ["event_id"])
    return table.read(spark)


# Jobs

_CRM_LANDED = "user_id string, email string, country string, _ingest_ts timestamp, _run_id string"


def _run_twice(
    spark: SparkSession, job: Job, sources: list[DataFrame], items=None
) -> DataFrame:
    """Run a job for one day once per source, from CSV files, and read its table."""
    metadata = metadata_table(spark, items)
    output = fresh_path(spark, job.item_name)
    for i, source in enumerate(sources, start=1):
        run_job(
            spark,
            job,
            {
                "inputPath": as_csv(source, job.item_name),
                "outputPath": output,
                "ds": DS,
                "run_id": f"run-{i}",
            },
            metadata,
        )
    landed = PathTable(output, job.output_schema).read(spark)
    return landed.withColumn("_ingest_ts", F.col("_ingest_ts").isNotNull())


def crm_users_catalog_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, rules and table from metadata alone; no path is given."""
    table = partitioned_table(spark, _CRM_LANDED)
    metadata = metadata_table(spark, _landing_in(table))
    source = crm_source(given(spark, sf_dir, "customer"))
    for i, some in enumerate((source.filter("country <> '3'"), source.filter("country <> '5'")), start=1):
        args = {"inputPath": as_csv(some, "crm_users"), "ds": DS, "run_id": f"run-{i}"}
        run_job(spark, CRM_USERS, args, metadata)
    return spark.table(table).withColumn("_ingest_ts", F.col("_ingest_ts").isNotNull())


def gate_shut_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run whose file fails a rule: the first run's rows, and what the gate said."""
    table = partitioned_table(spark, _CRM_LANDED)
    metadata = metadata_table(spark, _landing_in(table))
    source = crm_source(given(spark, sf_dir, "customer"))
    spoiled = source.withColumn("email", F.when(F.col("country") > "1", F.col("email")))
    said = "the gate let everything through"
    for i, some in enumerate((source, spoiled), start=1):
        args = {"inputPath": as_csv(some, "crm_users"), "ds": DS, "run_id": f"run-{i}"}
        try:
            run_job(spark, CRM_USERS, args, metadata)
        except QualityError as error:
            said = str(error).split(" details=")[0]
    landed = spark.table(table).withColumn("_ingest_ts", F.col("_ingest_ts").isNotNull())
    return landed.withColumn("message", F.lit(said))


def _landing_in(table: str) -> list[ItemDef]:
    return [
        replace(item, output_table=table) if item.item_name == CRM_USERS.item_name else item
        for item in registry()
    ]


def web_events_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run's file holds every event twice; the copy dated later wins."""
    source = web_source(given(spark, sf_dir, "events"))
    # What one file lacks the other has, so that every event lands.
    first_only = (F.col("props") == '{"k": 1}') & (F.col("event_type") != "signup")
    second = source.filter(~first_only)
    later = second.withColumns({"ts": F.lit("2024-03-01"), "event_type": F.lit("late")})
    return _run_twice(
        spark,
        WEB_EVENTS,
        [source.filter(F.col("event_type") != "signup"), second.unionByName(later)],
    )


def pos_transactions_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the shipped bound on amounts raised, which these prices exceed."""
    wide = RuleSpec("max_percentile", {"column": "amount", "p": "0.999", "max": "500000"})
    items = [
        replace(item, dq_rules=(item.dq_rules[0], wide))
        if item.item_name == POS_TRANSACTIONS.item_name
        else item
        for item in registry()
    ]
    source = pos_source(given(spark, sf_dir, "orders"))
    second = source.filter(F.col("currency") != "O").withColumn("currency", F.lit("EUR"))
    return _run_twice(spark, POS_TRANSACTIONS, [source, second], items)


def crm_users_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = crm_source(given(spark, sf_dir, "customer"))
    return _run_twice(
        spark,
        CRM_USERS,
        [source.filter(F.col("country") != "3"), source.filter(F.col("country") != "5")],
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        web_events_transform,
        pos_transactions_transform,
        crm_users_transform,
        event_date_fallback,
        ingestion_meta,
        single_partition,
        csv_roundtrip,
        csv_by_position,
        csv_missing_columns,
        csv_malformed,
        dq_filled_ratio,
        dq_value_ratio,
        dq_max_percentile,
        dq_landed_percentiles,
        dq_documents,
        dq_report,
        dq_gate,
        metadata_rules,
        dedupe_latest,
        dedupe_composite,
        dedupe_null_keys,
        overwrite_one_partition,
        overwrite_catalog_partition,
        merge_path_partition,
        merge_rerun,
        merge_catalog_partition,
        merge_bucketed,
        merge_composite,
        merge_hot_key,
        merge_few_corrections,
        merge_touched_files,
        overwrite_predicate,
        merge_backfill,
        web_events_job,
        pos_transactions_job,
        crm_users_job,
        crm_users_catalog_job,
        gate_shut_job,
    )
}
