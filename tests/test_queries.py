"""Every query with SQL against DuckDB, the others for rows and a stable schema."""

import math
import os

import duckdb
import pandas as pd
import pytest

from polyloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if not isinstance(x, str) and (x is None or pd.isna(x)):
            return None
        if isinstance(x, str) or isinstance(x, bool):
            return x
        return int(x) if math.isfinite(float(x)) and float(x) == int(x) else round(float(x), 8)

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"presence_clusters", "viability_model"}))
def test_rows_only(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["bootstrap_compatibility", "strategy_comparison", "cross_plan", "allele_clusters"])
def test_repeatable(spark, sf, name):
    """Seeded and serial operators give the same rows again."""
    first, again = (sorted(map(str, registry.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert first == again


@pytest.mark.parametrize("pipeline_there", [True, False])
def test_entry_without_training_data(tmp_path, pipeline_there):
    """The rest imports and lists its queries where the training-data folders are gone, with the pipeline's file or without."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/polyloom", tmp_path / "polyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    if pipeline_there and os.path.exists(f"{here}/corpus_pipeline.py"):
        shutil.copy(f"{here}/corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))], out.stderr
