import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "change"] and df.count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(TOP, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True)
