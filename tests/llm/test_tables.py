import pandas as pd
from pyspark.sql import functions as F

from sluiceway.llm.tables import _BATCH_BYTES, saved


def _batches(docs):
    def measure(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "bytes": [int(f["text"].str.len().sum())]})

    return saved(docs.mapInPandas(measure, "n long, bytes long"), "measured").collect()


def test_python_gets_long_texts_a_few_megabytes_at_a_time(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.expr("repeat('x', 8000)").alias("text"))
    rows = _batches(docs)
    assert sum(r.n for r in rows) == 4000 and max(r.bytes for r in rows) <= 5_000_000
    assert spark.conf.get(_BATCH_BYTES, None) is None


def test_a_bound_that_the_session_names_holds(spark):
    spark.conf.set(_BATCH_BYTES, "1m")
    try:
        rows = _batches(spark.range(0, 400, 1, 1).select(F.expr("repeat('x', 8000)").alias("text")))
        assert max(r.bytes for r in rows) <= 1_100_000 and spark.conf.get(_BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(_BATCH_BYTES)
