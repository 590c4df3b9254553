import uuid

import pytest

from sluiceway.operators.rules import FilledRatio, MaxPercentile, ValueRatio
from sluiceway.plans.metadata import (
    ITEM_SCHEMA,
    export_items,
    files_table,
    items_frame,
    load_item,
    registry,
    rule_rows,
)


@pytest.fixture
def table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta'")
    name = f"meta.items_{uuid.uuid4().hex}"
    export_items(spark, table=name, path=str(tmp_path / "items"))
    return name


def test_items_survive_the_table(spark, table):
    assert spark.table(table).schema == ITEM_SCHEMA
    for item in registry():
        assert load_item(spark, item.domain, item.item_name, table) == item


def test_export_replaces_the_table(spark, table, tmp_path):
    export_items(spark, registry()[:1], table=table, path=str(tmp_path / "items"))
    assert spark.table(table).count() == 1


def test_export_needs_the_database(spark):
    with pytest.raises(Exception, match="SCHEMA_NOT_FOUND"):
        export_items(spark, table="nowhere.item_defs")


def test_items_as_files_without_a_catalog(spark, tmp_path):
    path = str(tmp_path / "item files")
    export_items(spark, table=None, path=path)
    export_items(spark, table=None, path=path)
    assert load_item(spark, "core", "crm_users", files_table(path)) == registry()[0]


def test_lookup_failures(spark, table, tmp_path):
    with pytest.raises(LookupError, match="not found in .* for domain='core', itemName='x'"):
        load_item(spark, "core", "x", table)
    with pytest.raises(LookupError, match="domain='other'"):
        load_item(spark, "other", "crm_users", table)
    export_items(spark, registry() * 2, table=table, path=str(tmp_path / "twice"))
    with pytest.raises(LookupError, match="More than one"):
        load_item(spark, "core", "crm_users", table)


def test_shipped_rules_and_keys():
    items = {item.item_name: item for item in registry()}
    assert items["crm_users"].rules() == [
        FilledRatio("user_id", 0.999),
        FilledRatio("email", 0.98),
    ]
    assert items["pos_transactions"].rules() == [
        ValueRatio("amount", "gt", 0.0, 0.98),
        MaxPercentile("amount", 0.999, 5000.0),
    ]
    assert items["web_events"].rules() == [FilledRatio("event_id", 0.999)]
    assert {i.item_name: (i.domain, i.group_name, i.key_columns) for i in registry()} == {
        "crm_users": ("core", "crm", ("user_id",)),
        "pos_transactions": ("payments", "pos", ("transaction_id",)),
        "web_events": ("analytics", "web", ("event_id",)),
    }


def test_rules_unnest_to_one_row_each(spark):
    found = rule_rows(items_frame(spark, registry())).orderBy("itemName", "ruleType", "column")
    assert [(r.itemName, r.ruleType, r.column, r.min, r.max) for r in found.collect()] == [
        ("crm_users", "filled_ratio", "email", "0.98", None),
        ("crm_users", "filled_ratio", "user_id", "0.999", None),
        ("pos_transactions", "max_percentile", "amount", None, "5000"),
        ("pos_transactions", "value_ratio", "amount", "0.98", None),
        ("web_events", "filled_ratio", "event_id", "0.999", None),
    ]
