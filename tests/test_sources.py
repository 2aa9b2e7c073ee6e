from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillwork.operators.contracts import ContractError
from quillwork.sources import publish, strict
from quillwork.streaming import resume


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_csv(spark, tmp_path):
    url = write(tmp_path / "a.csv", '﻿id,name,note\n1,"a ""b"", c","two\nlines"\n2,, x \n')
    rows = [tuple(r) for r in strict.read_csv(spark, url, required=["id"]).orderBy("id").collect()]
    assert rows == [("1", 'a "b", c', "two\nlines"), ("2", "", " x ")]


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "a, \n1,2\n", ""])
def test_bad_headers(spark, tmp_path, text):
    with pytest.raises(ContractError):
        strict.read_csv(spark, write(tmp_path / "a.csv", text))


@pytest.mark.parametrize("text", ["a,b\n1,2,3\n", "a,b\n1\n"])
def test_bad_rows(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        strict.read_csv(spark, write(tmp_path / "a.csv", text)).collect()


def test_gzip_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    assert strict.read_csv(spark, f"file://{tmp_path}/a.csv.gz").first().b == "2"
    with pytest.raises(ContractError, match="missing"):
        strict.read_csv(spark, f"file://{tmp_path}/a.csv.gz", required=["c"])


def test_jsonl(spark, tmp_path):
    url = write(tmp_path / "a.jsonl", '{"k":"a","n":1}\n\n{"k":"b","n":2}\n')
    assert sorted((r.k, r.n) for r in strict.read_jsonl(spark, url, "k string, n long").collect()) == [("a", 1), ("b", 2)]
    for bad in ('{"k":1,"k":2}', '{"k":NaN}', '{"k":1} x', '{"n":1e999}'):
        with pytest.raises(Exception, match="not strict JSON"):
            strict.read_jsonl(spark, write(tmp_path / "b.jsonl", bad), "k string, n long").collect()


def test_aliases_layouts_and_filters(spark):
    df = spark.createDataFrame([("1", "x", "TRUE"), ("2", "y", "no"), ("1", "z", "1")], "GVKEY string, Exec_Id string, keep string")
    got = strict.select_aliases(df, {"gvkey": ["gvkey"], "execid": ["execid", "exec_id"], "name": ["name"]}, ["gvkey", "execid"])
    assert got.columns == ["gvkey", "execid"]
    with pytest.raises(ContractError):
        strict.select_aliases(df, {"year": ["year"]}, ["year"])
    assert [r[0] for r in strict.id_filter(df, "GVKEY", "keep").collect()] == ["1"]
    assert strict.layout(["a", "b"], {"one": ["a"], "two": ["a", "b"]}) == "two"
    strict.guard_header(["a"], ["a"], ["b"])
    with pytest.raises(ContractError):
        strict.guard_header(["a", "b"], ["a", "b"], ["b"])


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(10).withColumn("t", F.lit(" a  b "))
    told = publish.publish(publish.clean_cells(df), f"{root}/out")
    assert told["rows"] == 10 and publish.verify(spark, f"{root}/out")["rows"] == 10
    assert spark.read.parquet(f"{root}/out").first().t == "a b"
    with pytest.raises(ContractError, match="exists"):
        publish.publish(df, f"{root}/out")
    bad = df.withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception, match="boom"):
        publish.publish(bad, f"{root}/bad")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]
    publish.point_latest(spark, root, "out")
    assert publish.latest(spark, root) == f"{root}/out"
    (tmp_path / "locked.lock").touch()
    with pytest.raises(ContractError, match="being written"):
        publish.publish(df, f"{root}/locked")
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ContractError, match="differs"):
        publish.verify(spark, f"{root}/out")


def test_blinded_split_and_report(spark):
    df = spark.createDataFrame([(1, "text", "who")], "unit_id long, text string, model string")
    public, private = publish.split_blinded(df, ["text"], ["model"], "unit_id", "seed")
    assert public.columns == ["audit_id", "text"] and private.columns == ["audit_id", "unit_id", "model"]
    assert public.first().audit_id == private.first().audit_id
    assert "| 1 |" in publish.report("T", {"rows": df.select("unit_id")})
    with pytest.raises(ContractError):
        publish.report("T", {"rows": spark.range(5)}, rows=3)


def test_resumed_batches(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    batches = spark.createDataFrame([(k, k // 3) for k in range(8)], "event_id long, batch_id long")
    calls = []

    def work(ids):
        calls.append(ids.count())
        return ids.filter("event_id % 2 = 0").withColumn("n", F.lit(5))

    store = resume.BatchStore(spark, root, {"query": "counts", "v": 1})
    store.commit(0, batches.filter("batch_id = 0"), work(batches.filter("batch_id = 0").select("event_id")))
    with pytest.raises(ContractError, match="missing"):
        store.materialise(batches)
    again = resume.BatchStore(spark, root, {"v": 1, "query": "counts"})
    assert again.run(batches, work) == 2 and len(calls) == 3 and again.run(batches, work) == 0
    assert sorted((r.event_id, r.n) for r in again.materialise(batches).collect()) == [(k, 0 if k % 2 else 5) for k in range(8)]
    with pytest.raises(ContractError, match="another contract"):
        resume.BatchStore(spark, root, {"v": 2})
    with pytest.raises(ContractError, match="is committed"):
        again.commit(0, batches, batches.select("event_id").withColumn("n", F.lit(1)))
    with pytest.raises(ContractError, match="outside"):
        again.commit(9, batches.filter("batch_id = 0"), spark.createDataFrame([(99, 1)], "event_id long, n int"))


def test_streamed_results(spark, tmp_path):
    source, log, state = (f"file://{tmp_path}/{n}" for n in ("in", "log", "state"))
    schema = "custom_id string, status string"

    def arrive(name, rows):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("custom_id", "status"), r, strict=True))) for r in rows))

    arrive("1.json", [("a", "error"), ("b", "completed")])
    stream = lambda: resume.append_results(spark.readStream.schema(schema).json(source), log, state).awaitTermination()
    stream()
    arrive("2.json", [("a", "completed")])
    stream()
    arrive("3.json", [("a", "completed"), ("c", "completed")])
    stream()
    assert sorted((r.custom_id, r.status) for r in resume.read_results(spark, log).collect()) == [("a", "completed"), ("a", "error"), ("b", "completed"), ("c", "completed")]


def test_attempts_are_limited_within_a_batch_and_over_batches(spark, tmp_path):
    """Five rows of an id in one micro-batch: the first two stay; of one that was there once, one; counts are compacted."""
    log, state = f"file://{tmp_path}/log", f"file://{tmp_path}/state"
    schema = "custom_id string, status string"
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"custom_id": i, "status": s}) for i, s in rows))
        resume.append_results(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), log, state).awaitTermination()

    arrive("1.json", [("a", f"s{k}") for k in range(5)] + [("b", "s0")])
    assert sorted(tuple(r) for r in resume.read_results(spark, log).select("custom_id", "status").collect()) == [("a", "s0"), ("a", "s1"), ("b", "s0")]
    arrive("2.json", [("a", "s9"), ("b", "s1"), ("b", "s2"), ("c", "s0")])
    arrive("3.json", [("b", "s3"), ("c", "s1"), ("c", "s2")])
    counts = {r.custom_id: r["count"] for r in resume.read_results(spark, log).groupBy("custom_id").count().collect()}
    assert counts == {"a": 2, "b": 2, "c": 2}
    assert len(list((tmp_path / "log.counts").iterdir())) <= 2
