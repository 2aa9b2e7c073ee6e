"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.arrow import texts
from quillwork.llm.language_id import held_out
from quillwork.llm.repetition import SYMBOLS
from quillwork.tables import spread
from quillwork.storage import written

# Byte classes, in the order of their statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", SYMBOLS, b".,;:", b"!?", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _k
N_STATISTICS = 9 + len(_CLASSES) + 1
BINS = 4096
NEUTRAL = 0.5
FOLDS = 2  # of the labelled rows, for the calibration
FAN_IN, TREE_LEVELS = 256, 1  # up to 256 partitions' sums, of 2 KB a row, meet in a task; then a 256th as many


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a whole text: its size, its bytes by class, its words, their repetition, its lines."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1) / size if text else np.zeros(len(_CLASSES) + 1)
    if not n:
        return [0.0] * 9 + shares.tolist()
    counts = Counter(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x]
    top = max(counts.values()) / n
    entropy = (math.log(n) - sum(c * math.log(c) for c in counts.values()) / n) / math.log(n + 1)
    marked = sum(1 for w in words if w[-1] in SYMBOLS) / n
    return [math.log1p(n), mean, math.log1p(max(lengths)), len(counts) / n, top, entropy, same, 1 - len(set(lines)) / len(lines), marked, *shares.tolist()]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, held_out and the statistics (doubles, as bytes) of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(statistics(t), np.float64).tobytes() for _, part in texts(batch.column(2)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], [id_col, "held_out", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col).mapInArrow(apply, f"`{id_col}` {kind}, held_out boolean, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_STATISTICS)


def _summed(rows: DataFrame, per_batch, width: int) -> np.ndarray:
    """The sum over ``rows`` of a matrix with ``width`` columns: each partition adds up its own, Spark adds these row
    by row in a tree (FAN_IN partitions' rows in a task, then the sums), and only the total comes to the driver."""

    def local(task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                m = per_batch(batch)
                total = m if total is None else total + m
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["part", "k", "v"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return local(TaskContext.get().partitionId(), batches)

    def add(group: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(b, np.float64) for b in sorted(group.column("v").to_pylist()))
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), "k": group.column("k")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    kind, sums = "part int, k int, v binary", rows.mapInArrow(numbered, "part int, k int, v binary")
    for _ in range(TREE_LEVELS):
        sums = sums.groupBy(F.expr(f"part div {FAN_IN}"), "k").applyInArrow(add, kind)
    got = sums.groupBy("k").applyInArrow(add, kind).toArrow().sort_by("k")
    if not len(got):
        return np.zeros((0, width))
    return np.frombuffer(b"".join(got.column("v").to_pylist()), np.float64).reshape(-1, width)


def pool_adjacent_violators(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values`` by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    low: float = 0.0
    high: float = 1.0
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def map(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant: their products approximate a Gaussian kernel."""
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.ridge(x) - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.knots, self.levels), 0, 1)


def fit(labelled: DataFrame, n_features: int = 256, width: float = 4.0, penalty: float = 1e-3, seed: int = 29) -> Model | None:
    """Learns from all rows of ``labelled`` (x, y, fold). None without rows.

    The normal equations are summed for each fold; all of them give the ridge. Scores are calibrated on rows that
    their ridge hasn't seen: those of a fold by the equations of the other folds (of its own, if there is no other).
    """
    moments = _summed(labelled, lambda b: (lambda m: np.vstack([np.r_[m.sum(axis=0), len(m)], np.r_[(m * m).sum(axis=0), 0]]))(_matrix(b.column("x"))), N_STATISTICS + 1)
    if not len(moments):
        return None
    n = moments[0, -1]
    mean = moments[0, :-1] / n
    deviation = np.sqrt(np.maximum(moments[1, :-1] / n - mean**2, 1e-12)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(mean, deviation, rng.normal(size=(N_STATISTICS, n_features)) / width, rng.uniform(0, 2 * math.pi, n_features), np.zeros(n_features + 1))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        phi, y = model.map(_matrix(batch.column("x"))), batch.column("y").to_numpy().astype(float)
        fold = batch.column("fold").to_numpy()
        of = [(phi[fold == f], y[fold == f]) for f in range(FOLDS)]
        return np.vstack([np.hstack([p.T @ p, (p.T @ v)[:, None]]) for p, v in of])

    total = _summed(labelled, equations, n_features + 2).reshape(FOLDS, n_features + 1, n_features + 2)

    def solved(sums: np.ndarray) -> np.ndarray:
        rows = sums[-1, n_features]  # the constant's square, once a row
        return np.linalg.solve(sums[:, :-1] + penalty * rows / n_features * np.eye(n_features + 1), sums[:, -1])

    model.weights = solved(total.sum(axis=0))
    others = [total.sum(axis=0) - total[f] for f in range(FOLDS)]
    unseen = [replace(model, weights=solved(o) if o[-1, n_features] >= 1 else model.weights, low=-0.5, high=1.5) for o in others]
    model.low, model.high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch.column("x")), batch.column("fold").to_numpy()
            bins = np.zeros(len(x), np.int64)
            for f, m in enumerate(unseen):
                bins[fold == f] = m.bin(x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y").cast(pa.float64())], ["bin", "y"])

    table = labelled.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows
    fitted = pool_adjacent_violators(np.array([r.y for r in table]), np.array([float(r.n) for r in table]))
    centre = model.low + (np.array([r.bin for r in table]) + 0.5) * (model.high - model.low) / BINS
    weight = np.array([float(r.n) for r in table])
    _, block = np.unique(fitted, return_inverse=True)
    model.knots = np.bincount(block, centre * weight) / np.bincount(block, weight)
    model.levels = np.unique(fitted)
    return model


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **settings) -> DataFrame:
    """id, held_out, score and predicted of every row of ``docs``.

    Labels are learned from those of ids whose crc32 is not 0 modulo 5; null labels and ids are left out, and a row
    that repeats an id or a label counts as often as it joins. Statistics are of whole texts; null and empty texts
    have those of a text without words. Equal texts get equal scores. Without labels all scores are NEUTRAL; without
    documents there are no rows. Other columns are not read, whatever their names.
    """
    rows = written(features(spread(docs.select(id_col, text_col)), id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).filter("y is not null")
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = written(rows.filter("not held_out").join(known, F.col(id_col) == F.col("__id")).select("x", "y", fold), "labelled")
    model = fit(labelled, **settings)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            score = model.score(x) if model else np.full(len(x), NEUTRAL)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(apply, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
