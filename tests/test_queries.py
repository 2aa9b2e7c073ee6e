from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillwork import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def number(v):
    return round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    if name == "stratum_allocation":
        pytest.skip("too few orders in a stratum at this scale")
    found = duck.sql(plans.oracle_sql()[name])
    columns = sorted(found.columns)
    expected = sorted((tuple(number(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    df = plans.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted((tuple(number(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs_alike_twice(spark, sf_dir, name):
    runs = [sorted((tuple(number(x) for x in r) for r in plans.queries()[name](spark, sf_dir).collect()), key=repr) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0


def test_entry_without_the_corpus_operators():
    """The library and the entry import and list their queries when the llm folder and the pipeline are gone."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['quillwork.llm'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__spark_entry__.__file__).parent))
