import os

import pytest

import corpus_pipeline as P
from palimpsest.llm.queries import QUERIES

from .tools import ODD, documents, near_components, odd_columns

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    step = [docs]
    for name, f in P.STAGES:
        step.append(f(spark, step[-1], SF).cache())
        assert name == "sharding" or step[-1].columns == columns
    clean = {r.doc_id: r.text for r in step[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(i) == 0 for i in clean)
    assert {r.doc_id for r in step[2].collect()} == set(near_components(clean, 5).values())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert not any(t in r.text for r in step[3].collect() for t in items.values())
    assert step[5].count() == step[4].count()
    assert {r.shard for r in step[5].select("shard").distinct().collect()} <= set(range(24))


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_in_each_stage(spark, tmp_path, k):
    spark.createDataFrame([(1, "an item"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = P.STAGES[k]
    for rows in (ODD, []):
        d = odd_columns(documents(spark, rows))
        out = f(spark, d, str(tmp_path))
        out.count()
        assert name == "sharding" or out.columns == d.columns
