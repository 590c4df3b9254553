import glob
import os

import duckdb
import pytest

from sluiceway.llm.oracles import ORACLES
from sluiceway.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    tables = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        tables.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = tables.sql(ORACLES[name])
    frame = QUERIES[name](spark, DATA)
    order = sorted(frame.columns)
    assert order == sorted(want.columns)
    got = sorted(tuple(r[c] for c in order) for r in frame.collect())
    assert got == sorted(want.project(", ".join(order)).fetchall())
