from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quillwork import storage
from quillwork.llm import queries
from quillwork.storage import written
from quillwork.tables import table
from tests.llm.conftest import PROSE


def test_stages_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "substring_dedup", "decontaminate", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    folder = Path(storage.shared_dir(spark).removeprefix("file://")) / "quillwork"
    tables = set(folder.iterdir())
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*columns, "copy", "shuffle_key"] and out.count() > 0
    assert {f.name.rsplit("-", 1)[0] for f in set(folder.iterdir()) - tables} == {"pipeline-mixing"}


def test_stages_with_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE + " x", None, "a", None), (4, "12 34", "de", "b", 5)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema).unionByName(table(spark, sf_dir, "documents").selectExpr("doc_id + 100 doc_id", "text", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test")
    assert docs.count() > 0
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, sf_dir), "test")
    assert empty.count() == 0


def test_entry_lists_all():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {m for n in names if (m := n[: n.find("_") + 1]).startswith("op")}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    expected = sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


def test_shared_folder(spark, monkeypatch):
    """The session's setting, and an own local folder where there is none."""
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(storage, "CHECKPOINT_SETTING", "spark.quillwork.unset")
    own = storage.shared_dir(spark)
    assert own.startswith("file:///") and storage.shared_dir(spark) == own
    df = storage.written(spark.range(3), "x")
    assert df.count() == 3 and all(f.startswith(own) for f in df.inputFiles())
    storage.remove(df)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(df._quillwork_path).count()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(spark)
