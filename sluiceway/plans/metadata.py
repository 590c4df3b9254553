"""Item definitions: authored in code, exported to a table, read back by jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluiceway.operators.rules import Rule, build_rules

METADATA_TABLE = "meta.item_defs_v1"

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("groupName", T.StringType()),
        T.StructField("itemName", T.StringType()),
        T.StructField("keyColumns", T.ArrayType(T.StringType())),
        T.StructField(
            "dqRules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ruleType", T.StringType()),
                        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("outputTable", T.StringType()),
    ]
)


@dataclass(frozen=True)
class RuleSpec:
    rule_type: str
    params: dict[str, str]


@dataclass(frozen=True)
class ItemDef:
    domain: str
    group_name: str
    item_name: str
    key_columns: tuple[str, ...]
    dq_rules: tuple[RuleSpec, ...]
    output_table: str

    def rules(self) -> list[Rule]:
        return build_rules((spec.rule_type, spec.params) for spec in self.dq_rules)


def registry() -> list[ItemDef]:
    """The items this repository ships."""
    # Fixed values.
    return [
        ItemDef(
            domain="core",
            group_name="crm",
            item_name="crm_users",
            key_columns=("user_id",),
            dq_rules=(
                RuleSpec("filled_ratio", {"column": "user_id", "min": "0.999"}),
                RuleSpec("filled_ratio", {"column": "email", "min": "0.98"}),
            ),
            output_table="lake.silver.core_crm_users",
        ),
        ItemDef(
            domain="payments",
            group_name="pos",
            item_name="pos_transactions",
            key_columns=("transaction_id",),
            dq_rules=(
                RuleSpec(
                    "value_ratio",
                    {"column": "amount", "op": "gt", "value": "0.0", "min": "0.98"},
                ),
                RuleSpec("max_percentile", {"column": "amount", "p": "0.999", "max": "5000"}),
            ),
            output_table="lake.silver.payments_pos_transactions",
        ),
        ItemDef(
            domain="analytics",
            group_name="web",
            item_name="web_events",
            key_columns=("event_id",),
            dq_rules=(RuleSpec("filled_ratio", {"column": "event_id", "min": "0.999"}),),
            output_table="lake.silver.analytics_web_events",
        ),
    ]


def items_frame(spark: SparkSession, items: Iterable[ItemDef]) -> DataFrame:
    """Item definitions as a DataFrame with nested rules."""
    rows = [
        {
            "domain": item.domain,
            "groupName": item.group_name,
            "itemName": item.item_name,
            "keyColumns": list(item.key_columns),
            "dqRules": [
                {"ruleType": spec.rule_type, "params": list(spec.params.items())}
                for spec in item.dq_rules
            ],
            "outputTable": item.output_table,
        }
        for item in items
    ]
    # From Arrow, Spark plans a local table and starts no Python worker.
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(ITEM_SCHEMA))
    return spark.createDataFrame(table, ITEM_SCHEMA)


def export_items(
    spark: SparkSession,
    items: Sequence[ItemDef] | None = None,
    table: str | None = METADATA_TABLE,
    path: str | None = None,
) -> None:
    """Replace the metadata table, whose database must exist, with the registry or ``items``.

    ``path`` places its files. With ``table=None`` only the files are written; jobs then
    read them as ``files_table(path)``.
    """
    defs = items_frame(spark, registry() if items is None else items).coalesce(1)
    writer = defs.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if table is None:
        writer.save()
    else:
        writer.saveAsTable(table)


def files_table(path: str) -> str:
    """The name under which Spark reads Parquet files as a table, with no catalog."""
    return f"parquet.`{path}`"


def load_item(
    spark: SparkSession, domain: str, item_name: str, table: str = METADATA_TABLE
) -> ItemDef:
    """Read the one definition of an item; raise if there is none or more than one."""
    found = (
        spark.table(table)
        .filter((F.col("domain") == domain) & (F.col("itemName") == item_name))
        .limit(2)
        .collect()
    )
    where = f"in {table} for domain='{domain}', itemName='{item_name}'"
    if not found:
        raise LookupError(f"Item definition not found {where}")
    if len(found) > 1:
        raise LookupError(f"More than one item definition {where}")
    row = found[0]
    return ItemDef(
        domain=row.domain,
        group_name=row.groupName,
        item_name=row.itemName,
        key_columns=tuple(row.keyColumns),
        dq_rules=tuple(RuleSpec(rule.ruleType, rule.params) for rule in row.dqRules),
        output_table=row.outputTable,
    )


def rule_rows(items: DataFrame) -> DataFrame:
    """One row per rule of every item, with its parameters side by side."""
    rule = items.select(
        "domain", "groupName", "itemName", "outputTable", F.explode("dqRules").alias("rule")
    )
    return rule.select(
        "domain",
        "groupName",
        "itemName",
        "outputTable",
        F.col("rule.ruleType").alias("ruleType"),
        *(
            F.col("rule.params").getItem(name).alias(name)
            for name in ("column", "op", "value", "min", "p", "max")
        ),
    )
