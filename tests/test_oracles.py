"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pytest

from palimpsest import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    r = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert got, "a query without rows tests nothing"


def far_parts(con, tmp_path):
    """lineitem with keys of parts up to those of 60 times sf0.1, so that ranges end in each block and beyond the last."""
    rows = "select k * 4 + 4 - n as l_orderkey, k * 997 as l_partkey, n::int as l_linenumber, (k % 50 + 1)::double as l_quantity from range(1, 1300) a(k), range(1, 4) b(n)"
    con.execute(f"copy ({rows}) to '{tmp_path}/lineitem.parquet' (format parquet)")
    far = duckdb.connect()
    far.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    return far


def same_on_far_parts(spark, con, tmp_path, name):
    far = far_parts(con, tmp_path)
    r = far.execute(catalog.ORACLES[name])
    cols = [x[0] for x in r.description]
    got = [tuple(x) for x in catalog.QUERIES[name](spark, str(tmp_path)).select(cols).collect()]
    assert sorted(got) == sorted(r.fetchall())
    return got


def test_block_bitmap_of_far_parts(spark, con, tmp_path):
    got = same_on_far_parts(spark, con, tmp_path, "q33_block_bitmap")
    assert min(x[1] for x in got) < 0, "the last block is among them"


def test_block_covered_of_far_parts(spark, con, tmp_path):
    got = same_on_far_parts(spark, con, tmp_path, "q33_block_covered")
    assert {hit for *_, hit in got} == {True, False}


@pytest.mark.parametrize("name", ["q33_block_bitmap", "q33_block_covered"])
def test_blocks_of_parts_beyond_an_int_and_of_none(spark, tmp_path, name):
    """Numbers of blocks past 2^31, parts without a key, and empty ranges of those."""
    part = "case when k % 5 > 0 then k % 50 * 1000000000000 end"
    far = duckdb.connect()
    far.execute(f"copy (select k * 4 + 1 as l_orderkey, {part} as l_partkey, (k % 7 + 1)::int as l_linenumber, (k % 50 + 1)::double as l_quantity from range(1, 400) a(k)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    far.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    r = far.execute(catalog.ORACLES[name])
    cols = [x[0] for x in r.description]
    got = [tuple(x) for x in catalog.QUERIES[name](spark, str(tmp_path)).select(cols).collect()]
    assert sorted(got, key=str) == sorted(r.fetchall(), key=str)
    assert any(x[cols.index("id")] is None for x in got) and max(x[cols.index("id")] or 0 for x in got) * 7 >> 16 >= 1 << 31
