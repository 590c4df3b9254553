import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sluiceway.llm.exact_dedup import exact_groups
from sluiceway.llm.tables import without
from tests.llm.helpers import DOCS, ODD, documents


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        same = groups[text or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_groups_of_odd_texts_ties_and_hot_copies(spark):
    texts = ODD + ["hot"] * 700 + [f"t{i % 40}" for i in range(400)]
    docs = documents(spark, texts).repartition(7)
    assert found(exact_groups(docs)) == expected(list(enumerate(texts)))


def test_texts_that_share_a_digest_stay_apart(spark):
    texts = ODD + ["ab", "ba", "ab", "cd"] * 30
    weak = lambda text: F.length(text).cast("string")
    rows = exact_groups(documents(spark, texts).repartition(5), digest=weak).drop("digest")
    assert found(rows) == [r[:4] for r in expected(list(enumerate(texts)))]


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"digest": F.lit(1), "salt": F.lit(2), "content": F.lit("c"), "best": F.lit(3), "__hot": F.lit(True)}
    )
    assert found(exact_groups(docs)) == expected(rows)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_main_path_runs_no_python(spark):
    plan = exact_groups(documents(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_without_drops_exactly_the_ids(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id").unionByName(spark.sql("select cast(null as long) doc_id"))
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)] * 2, "x long")
    left = {r[0] for r in without(rows, gone, "doc_id").collect()}
    assert left == {i for i in range(500) if i % 3} | {None}
