from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwork.llm import mixing
from quillwork.tables import table
from tests.llm.conftest import documents


def test_counts_follow_a_poisson_law(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    mixed = mixing.mix(documents(spark, rows)).select("doc_id", "source", "copy").collect()
    n, names = Counter(r[3] for r in rows), {r[3] for r in rows}
    for source in names:
        rate = len(rows) / (len(names) * n[source])
        times = Counter(r.doc_id for r in mixed if r.source == source)
        found = Counter(times.get(i, 0) for i, _, _, s in rows if s == source)
        for k in range(4):
            expected = n[source] * math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(found[k] - expected) < 5 * math.sqrt(expected) + 3
        assert all(sorted(r.copy for r in mixed if r.doc_id == i) == list(range(1, t + 1)) for i, t in list(times.items())[:20])


def test_weights_and_their_bounds(spark):
    rows = [(i, "t", "en", "a" if i < 900 else "b") for i in range(1000)]
    docs = documents(spark, rows)
    got = Counter(r.source for r in mixing.mix(docs, weights={"a": 1, "b": 3, "absent": 5}).collect())
    assert abs(got["a"] - 250) < 100 and abs(got["b"] - 750) < 150
    assert mixing.mix(docs, weights={"b": 0}).count() == 0
    with pytest.raises(Exception, match="max_rate"):
        mixing.mix(docs, weights={"b": 1}, max_rate=5.0).count()


def test_repeatable_and_shuffled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    runs = [sorted((r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]
    order = [r.doc_id for r in mixing.mix(docs).coalesce(1).collect()]
    assert order != sorted(order)
    assert mixing.mix(docs).columns == [*docs.columns, "copy", "shuffle_key"]


def test_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    out = mixing.mix(docs)
    assert set(out.columns) == {*docs.columns, "shuffle_key"}
    got = Counter(r.doc_id for r in out.collect())
    assert got[1] % 2 == 0  # both rows share a draw
    assert mixing.mix(docs.limit(0)).count() == 0


def test_cumulative_sums(spark):
    got = spark.createDataFrame([(0.0,), (0.3,), (4.0,), (120.0,)], "rate double").select("rate", mixing.cumulative(F.col("rate")).alias("s")).collect()
    for r in got:
        assert abs(r.s[-1] - 1) < 1e-9
        assert all(abs(x - sum(math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1)) if r.rate else float(k == 0) for k in range(j + 1))) < 1e-9 for j, x in enumerate(r.s[:8]))


def test_plan_has_no_python(spark, sf_dir):
    plan = mixing.mix(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_high_rates_are_drawn(spark):
    """A source of a few rows among many (rate over 700) keeps its weight, and all others theirs; none fails."""
    rows = [(i, "t", "en", f"s{i % 3}") for i in range(30000)] + [(-1, "t", "en", None), (-2, "t", "en", "rare"), (-3, "t", "en", "rare"), (-4, "t", "en", "rare")]
    mixed = mixing.mix(documents(spark, rows))
    assert mixed.schema["copy"].dataType.simpleString() == "int"
    got = mixed.select("doc_id", "copy", "source", "shuffle_key").collect()
    assert len({r.shuffle_key for r in got}) == len(got)
    target = len(rows) / 5
    assert all(abs(k - target) < 5 * math.sqrt(target) for k in Counter(r.source for r in got).values())
    times = {i: sorted(r.copy for r in got if r.doc_id == i) for i in (-1, -2, -3, -4)}
    assert all(t == list(range(1, len(t) + 1)) for t in times.values())
    assert len({len(times[i]) for i in (-2, -3, -4)}) > 1
    again = mixing.mix(documents(spark, rows).repartition(5)).select("doc_id", "copy", "source", "shuffle_key").collect()
    assert sorted(r.shuffle_key for r in again) == sorted(r.shuffle_key for r in got)


def test_high_rates_follow_a_poisson_law(spark):
    """1,000 rows of rate 1,500: mean and variance of their draws are those of the law."""
    docs = spark.range(1000).selectExpr("id as doc_id", "'rare' as source")
    table = spark.range(1).select(F.lit("rare").alias("source"), F.lit(3).cast("long").alias("__parts"), mixing.cumulative(F.lit(500.0)).alias("__sums"))
    joined = docs.join(table.withColumnRenamed("source", "__source"), F.col("source") == F.col("__source"))
    times = [r["count"] for r in mixing._many_copies(joined, "doc_id", 7).groupBy("doc_id").count().collect()]
    mean = sum(times) / 1000
    assert len(times) == 1000 and abs(mean - 1500) < 5 * math.sqrt(1.5)
    assert abs(sum((t - mean) ** 2 for t in times) / 999 - 1500) < 5 * 1500 * math.sqrt(2 / 999)


def test_rows_without_id_are_drawn_one_by_one(spark):
    rows = [(None, f"t{k}", "en", "a") for k in range(2000)] + [(k, "t", "en", "b") for k in range(2000)]
    got = mixing.mix(documents(spark, rows)).select("doc_id", "text", "copy", "source", "shuffle_key").collect()
    times = Counter(r.text for r in got if r.source == "a")
    found = Counter(times.get(f"t{k}", 0) for k in range(2000))
    assert all(abs(found[k] - 2000 * math.exp(-1) / math.factorial(k)) < 5 * math.sqrt(2000 * math.exp(-1)) for k in range(4))
    assert len({r.shuffle_key for r in got}) == len(got)


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(5, f"text {k}", "en", "a") for k in range(2000)], "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs, seed=1).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert not found or max(r["count"] for r in found) < 0.6 * sum(r["count"] for r in found)
