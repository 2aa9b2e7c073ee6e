from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillwork.llm import quality
from quillwork.tables import table
from tests.llm.conftest import documents


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95
    assert sum(r.predicted == r.quality for r in got) > 0.9 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in quality.classify(docs, x).collect())
    assert key(labels) == key(flipped)


def test_odd_rows(spark, sf_dir, odd_rows):
    docs = documents(spark, odd_rows + [(r.doc_id + 1000, r.text, r.lang, r.source) for r in table(spark, sf_dir, "documents").collect()])
    labels = table(spark, sf_dir, "labels").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1


def test_no_labels(spark, odd_rows):
    docs = documents(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {quality.NEUTRAL}
    assert quality.classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], none.schema)
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())


def test_pool_adjacent_violators():
    got = quality.pool_adjacent_violators(np.array([0.0, 3, 1, 2, 2, 5]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert got.tolist() == [0, 2, 2, 2, 2, 5]


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    n, d = 4000, quality.N_STATISTICS
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, n)) / 4, rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1))
    x = rng.normal(size=(5, d))
    phi = model.map(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 32)
    assert np.abs(phi @ phi.T - kernel).max() < 0.1


def test_scores_equal_a_dense_computation(spark, sf_dir):
    """All steps in numpy over the collected rows: features, ridge, folds' ridges, isotonic levels of unseen scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.features(docs, "doc_id", "text").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(quality.FOLDS))).join(labels, "doc_id", "left").collect()
    x = np.array([np.frombuffer(r.x, np.float64) for r in rows])
    seen = np.array([not r.held_out and r.quality is not None for r in rows])
    y, fold = np.array([float(r.quality or 0) for r in rows]), np.array([r.fold for r in rows])
    n, d = 256, quality.N_STATISTICS
    rng = np.random.default_rng(29)
    model = quality.Model(x[seen].mean(axis=0), np.sqrt(np.maximum((x[seen] ** 2).mean(axis=0) - x[seen].mean(axis=0) ** 2, 1e-12)) + 1e-6, rng.normal(size=(d, n)) / 4.0, rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1))
    phi = model.map(x)

    def ridge(of):
        return np.linalg.solve(phi[of].T @ phi[of] + 1e-3 * of.sum() / n * np.eye(n + 1), phi[of].T @ y[of])

    unseen = np.where(fold == 0, phi @ ridge(seen & (fold != 0)), phi @ ridge(seen & (fold == 0)))
    bins = np.clip((unseen + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(bins[seen])
    means, weights = np.array([y[seen & (bins == b)].mean() for b in used]), np.array([float((seen & (bins == b)).sum()) for b in used])
    levels = quality.pool_adjacent_violators(means, weights)
    knots = [np.average((used[levels == v] + 0.5) * 2 / quality.BINS - 0.5, weights=weights[levels == v]) for v in np.unique(levels)]
    expected = np.interp(phi @ ridge(seen), knots, np.unique(levels))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert max(abs(got[r.doc_id] - s) for r, s in zip(rows, expected)) < 1e-6


def test_columns_of_any_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("*", "1 AS x", "2 AS fold", "3 AS __id", "4 AS y")
    assert quality.classify(docs, table(spark, sf_dir, "labels")).count() == docs.count()
