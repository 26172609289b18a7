"""The training-data queries with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from palimpsest.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    r = con.execute(ORACLES[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    assert sorted(got, key=str) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
    assert len(at) == len(r.description)
