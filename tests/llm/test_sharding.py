import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import sharding as H

from .tools import ODD, documents, odd_columns


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve(spark, n, bits):
    """Each cell once, and each step to a neighbour."""
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, [f"c{k}" for k in range(n)])
    got = {r[-1]: r[:-1] for r in df.select("*", H.hilbert([F.col(f"c{k}") for k in range(n)], bits)).collect()}
    assert sorted(got) == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(got[h], got[h + 1], strict=True)) == 1 for h in range(len(got) - 1))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_starts_need_no_python_rows(spark, n):
    """What comes before each partition is a local relation: rows from Python would start Python workers in the executors."""
    rows = spark.range(n).repartition(3).select((F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("__at"))
    starts, total = H._starts(rows)
    got = sorted(starts.collect())
    assert total == n and [s for _, s in got][:1] == [0] * min(n, 1)
    assert "RDD" not in starts._jdf.queryExecution().logical().toString()
    assert starts.dtypes == [("__part", "bigint"), ("__start", "bigint")]


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 500])
def test_law(spark, n):
    d = documents(spark, {i: "x" * (i % 7) for i in range(n)}, source=lambda i: f"s{i % 5}", lang="en")
    rows = H.assign(d).collect()
    assert len(rows) == n and all(r.law == "rows" and r.size == r.doc_id % 7 + 8 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, ())) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(24))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_cells_hold_about_equally_many_rows(spark):
    """Strings of one beginning are told apart, by the rows that they have and not by how they are spelt."""
    rows = [(i, "", "en", f"common-crawl-{i % 40:02d}" if i % 2 else "common-crawl-00", i * i) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert H.cuts(d, "lang", 8) == [("en", 4)]
    for name, value in (("source", lambda r: r[3]), ("n_chars", lambda r: r[4])):
        cuts = H.cuts(d, name, 8)
        assert [c for _, c in cuts] == sorted({c for _, c in cuts}) and all(0 <= c < 8 for _, c in cuts)
        ordered, at = sorted(map(value, rows)), {}
        for k, v in enumerate(ordered):
            at.setdefault(v, []).append(k)
        for v, places in at.items():
            middle = (places[0] + places[-1] + 1) / 2
            assert max((c for w, c in cuts if w <= v), default=0) == int(middle * 8 // len(rows)), v


def test_odd_rows(spark):
    d = odd_columns(documents(spark, ODD))
    rows = H.assign(d).collect()
    assert len(rows) == len(ODD)
    null = next(r for r in rows if r.doc_id == 1)
    assert null.size == 8 and null.text_crc32 is None
    out = H.with_shards(d)
    assert out.columns == [*d.columns, "__shard", "__slot"]
    assert out.count() == len(ODD)
    assert H.with_shards(documents(spark, {})).columns[-2:] == ["shard", "slot"]
