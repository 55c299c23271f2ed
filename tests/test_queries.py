"""Every query of the operators against its SQL, on the smallest tables."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomwright.queries import QUERIES, oracle_sql, queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in sorted(Path(DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, bool) or isinstance(value, str):
        return value
    return float(value)


@pytest.mark.skipif(not Path(DIR).is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = queries()[name](spark, DIR)
    rows = [[plain(v) for v in r] for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    if name in oracle_sql():
        found = oracle.execute(oracle_sql()[name])
        names = [d[0] for d in found.description]
        order = [names.index(n) for n in sorted(names)]
        assert sorted(df.columns) == sorted(names)
        want = [[plain(r[i]) for i in order] for r in found.fetchall()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry_module_imports_and_lists_the_queries():
    import __spark_entry__ as entries

    assert set(QUERIES) <= set(entries.queries()) and set(entries.oracle_sql()) <= set(entries.queries())


RUN_WITHOUT = """
import __spark_entry__ as entries
from pyspark.sql import SparkSession
names = entries.queries()
assert names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(entries.oracle_sql()) <= set(names), names
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert entries.entry(spark).count() > 0
"""


@pytest.mark.skipif(not Path(DIR).is_dir(), reason="no tables here")
@pytest.mark.parametrize("gone", [("loomwright/llm", "tests/llm"), ("loomwright/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", RUN_WITHOUT], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
