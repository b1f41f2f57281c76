"""Every catalogue query against its SQL, both of which must return rows."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from docquery_spark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables aren't here")


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return None if v is pd.NA or v is pd.NaT else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)
        assert rows(got) == rows(want)


def test_entry_imports_without_the_training_data_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "docquery_spark", tmp_path / "docquery_spark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('rows', q['table_row_gate'](s, '').count())"
    env = {k: v for k, v in os.environ.items() if k in ("PATH", "JAVA_HOME", "HOME")} | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert done.returncode == 0 and "rows 2" in done.stdout, done.stderr
