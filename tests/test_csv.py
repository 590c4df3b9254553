import pytest
from pyspark.sql import types as T

from sluiceway.operators.quality import staged_check
from sluiceway.operators.rules import build_rules
from sluiceway.plans.jobs import CRM_USERS_SOURCE, POS_TRANSACTIONS_SOURCE
from sluiceway.sources.csv import read_csv
from tests.conftest import rows


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_columns_bind_by_position_and_surplus_ones_are_dropped(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,mail,since,age,sex\nu1,a@b.c,2024-01-01,34,F\n")
    df = read_csv(spark, path, CRM_USERS_SOURCE)
    assert df.columns == ["user_id", "email", "country", "created_at"]
    assert rows(df) == [("u1", "a@b.c", "2024-01-01", "34")]


def test_missing_columns_are_null(spark, tmp_path):
    path = write(tmp_path, "a.csv", "user_id,email\nu1,a@b.c\n")
    assert rows(read_csv(spark, path, CRM_USERS_SOURCE)) == [
        ("u1", "a@b.c", None, None)
    ]


def test_empty_field_is_null_but_the_word_null_is_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", "user_id,email,country,created_at\n,null,,x\n")
    assert rows(read_csv(spark, path, CRM_USERS_SOURCE)) == [(None, "null", None, "x")]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_number_that_does_not_parse_is_null(spark, tmp_path, ansi):
    header = "transaction_id,user_id,store_id,amount,currency,timestamp\n"
    path = write(tmp_path, "a.csv", header + "1,u,s,null,EUR,t\n2,u,s,12.5,EUR,t\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = read_csv(spark, path, POS_TRANSACTIONS_SOURCE)
        assert rows(df, "transaction_id", "amount") == [("1", None), ("2", 12.5)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_declared_not_null_is_not_enforced(spark, tmp_path):
    path = write(tmp_path, "a.csv", "user_id,email,country,created_at\n,a,b,c\n")
    df = read_csv(spark, path, CRM_USERS_SOURCE)
    assert isinstance(df.schema["user_id"].dataType, T.StringType)
    assert df.filter("user_id is null").count() == 1


def test_folder_and_glob(spark, tmp_path):
    for name in ("a1.csv", "a2.csv", "b.csv"):
        write(tmp_path, name, f"user_id,email,country,created_at\n{name},m,c,d\n")
    schema = CRM_USERS_SOURCE
    assert read_csv(spark, str(tmp_path), schema).count() == 3
    assert read_csv(spark, str(tmp_path / "a*.csv"), schema).count() == 2


def test_strict_header_rejects_other_names(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,mail,land,since\nu1,a,b,c\n")
    with pytest.raises(Exception, match="header does not conform"):
        read_csv(spark, path, CRM_USERS_SOURCE, strict_header=True).collect()
    good = write(tmp_path, "b.csv", "user_id,email,country,created_at\nu1,a,b,c\n")
    assert read_csv(spark, good, CRM_USERS_SOURCE, strict_header=True).count() == 1


def test_malformed_rows_are_shown_and_change_nothing_else(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text("a,b,c\n1,2,x\n1\n3,none,y\n4,5,z,more\n,,\n")
    schema = T.StructType.fromDDL("a int, b int, c string")
    plain = read_csv(spark, str(path), schema)
    shown = read_csv(spark, str(path), schema, malformed="line")
    assert rows(shown, "a", "b", "c") == rows(plain)
    assert sorted(r.line for r in shown.collect() if r.line) == ["1", "3,none,y", "4,5,z,more"]
    # The same lines are malformed whatever columns are asked for.
    for columns in (["c", "line"], ["line"]):
        assert sorted(r.line for r in shown.select(columns).collect() if r.line) == ["1", "3,none,y", "4,5,z,more"]


def test_a_rule_on_the_share_of_malformed_rows(spark, tmp_path, folder):
    path = tmp_path / "broken.csv"
    path.write_text("a,b\n1,2\n1\n3,4\n5,6\n")
    read = read_csv(spark, str(path), T.StructType.fromDDL("a int, b int"), malformed="line")
    rules = build_rules([("malformed_ratio", {"column": "line", "max": m}) for m in ("0.25", "0.2")])
    _, results = staged_check(read, rules, folder)
    assert [(r.name, r.observed, r.ok) for r in results] == [
        ("malformed_ratio(line)<=0.25", 0.25, True), ("malformed_ratio(line)<=0.2", 0.25, False)
    ]
    assert not any(r.ok for r in staged_check(read.limit(0), rules, f"{folder}-empty")[1])
    with pytest.raises(ValueError, match="must be in"):
        build_rules([("malformed_ratio", {"column": "line", "max": "2"})])
