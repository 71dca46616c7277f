"""Every registered query runs on the smallest tables and equals its SQL there."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumenfold.queries import corpora, scores, talks, texts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings passages articles ood_passages se_locked heldout_items taxonomy_subtopics passage_vectors".split()
CORE = {n: (q, r.sql.get(n)) for r in (texts.R, corpora.R, scores.R, talks.R) for n, q in r.queries.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(df):
    def plain(x):
        if x is None or (not isinstance(x, (list, dict)) and not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") and getattr(x, "ndim", 1) == 0 and x.dtype.kind in "iuf" else str(x)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if sql))
def test_equals_sql(spark, sf_dir, duck, name):
    query, sql = CORE[name]
    got, want = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if not sql))
def test_runs(spark, sf_dir, name):
    assert CORE[name][0](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


def test_the_rest_does_not_need_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    assert not [p for p in (root / "lumenfold").rglob("*.py") if p.parent.name != "llm" and "lumenfold.llm" in p.read_text()]
    code = "import sys; sys.modules['lumenfold.llm'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) == len(CORE)
