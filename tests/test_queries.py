import os
from pathlib import Path

import duckdb
import pytest

from arbora.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    rows = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
