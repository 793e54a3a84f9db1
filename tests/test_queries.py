"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from pagelift import queries

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in rel.fetchall()]
    assert columns == sorted(names)
    assert ordered([tuple(r[c] for c in columns) for r in df.collect()]) == ordered(want)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_operators_for_training_data(tmp_path):
    """The subpackage and the pipeline may be left out; the rest works as before."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'extract_articles' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(queries.QUERIES), out.stderr
