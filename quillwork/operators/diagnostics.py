"""Length diagnostics: optimal matching, bootstrap intervals, OLS with HC3 errors (M-7 to M-9)."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.ranges import range_number
from quillwork.operators.contracts import ContractError

REFERENCE_WORDS = 140
MAX_VALUES = 100_000


Runs = list[tuple[int, int]]  # slope, width: a concave function from 0 on, flat after its last run


def _edge(own: Runs, other: Runs, gain: int, size: int, across: int) -> Runs:
    """The best score along the far edge of a block of ``size`` units of one length by ``across`` of another, each pair
    worth ``gain``; ``own`` is the score along the near edge beside it, ``other`` along the near edge across.

    The far edge is reached from ``other`` (the slopes are what a pair is worth more than what its partner had) or from
    ``own`` (its slopes with the pairs put in order). The first leads at the start and, once behind, stays so.
    """
    lead = sum(s * n for s, n in other)
    behind = [r for r in own if r[0] >= gain] + [(gain, across)] + [r for r in own if r[0] < gain] + [(0, size)]
    ahead = [(gain, across - sum(n for _, n in other))] + [(gain - s, n) for s, n in reversed(other) if s < gain] + [(0, size)]
    out: Runs = []

    def add(slope: int, width: int) -> None:
        nonlocal size
        width = min(width, size)
        size -= width
        if width and slope:
            out.append((slope, width + (out.pop()[1] if out and out[-1][0] == slope else 0)))

    (fast, m), (slow, n), i, j = behind[0], ahead[0], 0, 0
    while size:
        if not m:
            i += 1
            fast, m = behind[i]
        elif not n:
            j += 1
            slow, n = ahead[j]
        elif (step := min(m, n)) * (fast - slow) <= lead:
            add(slow, step)
            lead, m, n = lead - step * (fast - slow), m - step, n - step
        else:
            step, lead = divmod(lead, fast - slow)
            for run in [(slow, step), (fast - lead, 1), (fast, m - step - 1), *behind[i + 1 :]]:
                add(*run)
            break
    return out


def _cut(runs: Runs, size: int) -> Runs:
    ends = itertools.accumulate(n for _, n in runs)
    return [(s, n - max(0, end - size)) for (s, n), end in zip(runs, ends) if end - n < size]


def match_counts(pre: list[tuple[int, int]], qa: list[tuple[int, int]], caliper: int) -> list[tuple[int, int, int, int, int]]:
    """M-8 over (words, units) of each length, in order: (place of the length, first unit of it) of either side, pairs.

    The pairs are those of the table of best (pairs, distance) over all units, read from its end: leave out the last
    presentation unit where nothing is lost by it, else the last Q&A unit where nothing is lost, else pair them. In the
    block of two lengths every pair is worth the same, so the best along its edges is concave and kept as runs of slopes,
    and the way back through it is one run of each kind. So time goes with the lengths and their neighbours within the
    caliper, not with the units. Blocks are made again from every ``stride``-th length on, so that few are held.
    """
    scale = (caliper + 1) * (min(sum(n for _, n in pre), sum(n for _, n in qa)) + 1) + 1  # a pair is worth scale - distance
    lengths, stride = [w for w, _ in qa], math.isqrt(len(pre)) + 1
    reach = [(bisect.bisect_left(lengths, w - caliper), bisect.bisect_right(lengths, w + caliper)) for w, _ in pre]

    def blocks(i: int, below: dict[int, Runs]) -> dict[int, tuple[Runs, Runs]]:
        (u, p), left, near = pre[i], [], {}
        for j in range(*reach[i]):
            (v, q), under = qa[j], below.get(j, [])
            near[j], gain = (left, under), scale - abs(u - v)
            left, below[j] = _edge(left, under, gain, p, q), _edge(under, left, gain, q, p)
        return near

    saved, below = [], {}
    for i, (low, _) in enumerate(reach):
        if i % stride == 0:
            below = {j: runs for j, runs in below.items() if j >= low}
            saved.append(dict(below))
        blocks(i, below)

    width = lambda runs: sum(n for _, n in runs)
    found, start, i, j = [], len(pre), len(pre) - 1, len(qa) - 1
    x, y = pre[-1][1] if pre else 0, qa[-1][1] if qa else 0  # units left of lengths i and j
    while i >= 0 and j >= 0:
        if i < start:
            start = i - i % stride
            below = dict(saved[start // stride])
            held = [blocks(k, below) for k in range(start, i + 1)]
        gap = pre[i][0] - qa[j][0]
        if gap > caliper:
            x = 0
        elif -gap > caliper:
            y = 0
        else:
            (left, under), gain = held[i - start][j], scale - abs(gap)
            x = width(_edge(left, _cut(under, y), gain, x, y))
            y = width(_edge(under, _cut(left, x), gain, y, x))
            n = min(x, y)
            x, y = x - n, y - n
            if n:
                found.append((i, x, j, y, n))
        if not x:
            i, x = i - 1, pre[i - 1][1]
        if not y:
            j, y = j - 1, qa[j - 1][1]
    return found[::-1]


def match_ordered(pre: list[tuple[int, str]], qa: list[tuple[int, str]], caliper: int) -> list[tuple[int, int]]:
    """M-8: places of the pairs, both lists sorted by (words, id), that are the most and then the nearest."""
    a, b = ([(w, len(list(g))) for w, g in itertools.groupby(w for w, _ in rows)] for rows in (pre, qa))
    at, to = ([0, *itertools.accumulate(n for _, n in x)] for x in (a, b))
    return [(at[i] + x + k, to[j] + y + k) for i, x, j, y, n in match_counts(a, b, caliper) for k in range(n)]


def length_matches(units: DataFrame, caliper: int = 15) -> DataFrame:
    """M-8: pairs of a presentation and a Q&A unit of one period (period_bin, section, unit_id, words, score).

    What is matched are counts of units by length, in pieces: where two lengths of a period that follow each other are
    more than the caliper apart, no pair spans the gap, so each piece is a task of its own. Units are numbered within
    their length by id, in ranges of the id, and take their partners by number; they stay spread over the cluster.
    """
    typed = units.select(F.col("period_bin").cast("string").alias("period_bin"), "section", F.col("unit_id").cast("string").alias("unit_id"), F.col("words").cast("long").alias("words"), F.col("score").cast("double").alias("score"))
    typed = typed.filter(F.col("section").isin("PRE", "Q&A") & F.col("period_bin").isNotNull() & F.col("words").isNotNull())
    typed = typed.withColumn("range", F.when(F.col("unit_id").isNotNull(), range_number(typed, "unit_id")).otherwise(2**31 - 1))  # without id: last
    length = ["period_bin", "section", "words"]
    ranges = typed.groupBy(*length, "range").agg(F.count("*").alias("n"))

    of = lambda section: F.sum(F.when(F.col("section") == section, F.col("n")).otherwise(0))
    lengths = ranges.groupBy("period_bin", "words").agg(of("PRE").alias("pre"), of("Q&A").alias("qa"))
    order = Window.partitionBy("period_bin").orderBy("words")  # the windows stand over distinct lengths, not units
    gaps = lengths.withColumn("gap", F.col("words") - F.lag("words").over(order))
    pieces = gaps.withColumn("piece", F.sum(F.when(F.col("gap") > caliper, 1).otherwise(0)).over(order))

    def per_piece(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("words")
        pre, qa = ([(int(w), int(n)) for w, n in zip(rows.words, rows[c]) if n] for c in ("pre", "qa"))
        runs = [(rows.period_bin.iloc[0], pre[i][0], x, qa[j][0], y, n) for i, x, j, y, n in match_counts(pre, qa, caliper)]
        return pd.DataFrame(runs, columns=["period_bin", "pre_words", "pre_first", "qa_words", "qa_first", "pairs"])

    runs = pieces.groupBy("period_bin", "piece").applyInPandas(per_piece, "period_bin string, pre_words long, pre_first long, qa_words long, qa_first long, pairs long")
    side = lambda section, s: F.struct(F.lit(section).alias("section"), F.col(f"{s}_words").alias("words"), F.col(f"{s}_first").alias("first"))
    sides = runs.select("period_bin", "pre_words", "qa_words", "pairs", F.inline(F.array(side("PRE", "pre"), side("Q&A", "qa"))))
    earlier = Window.partitionBy(*length).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = before.join(sides, length).filter("first < before + n and before < first + pairs").select(*length, "range", "pre_words", "qa_words", "pairs", (F.col("before") - F.col("first")).alias("shift"))

    numbered = typed.withColumn("number", F.row_number().over(Window.partitionBy(*length, "range").orderBy("unit_id", "score")) - 1)
    placed = numbered.join(wanted, [*length, "range"]).withColumn("pair", F.col("number") + F.col("shift")).filter("pair >= 0 and pair < pairs")
    pick = lambda section, c: F.max(F.when(F.col("section") == section, F.col(c)))  # noqa: E731  there is one of each
    pairs = placed.groupBy("period_bin", "pre_words", "qa_words", "pair").agg(pick("PRE", "unit_id").alias("pre_unit_id"), pick("Q&A", "unit_id").alias("qa_unit_id"), (pick("Q&A", "score") - pick("PRE", "score")).alias("qa_minus_pre_score"))
    return pairs.select("period_bin", "pre_unit_id", "qa_unit_id", "pre_words", "qa_words", F.abs(F.col("pre_words") - F.col("qa_words")).alias("absolute_word_difference"), "qa_minus_pre_score")


def bootstrap(values: DataFrame, value: str, group: str | None = None, draws: int = 10_000, seed: int = 20260720, tasks: int = 16) -> DataFrame:
    """M-7: one row: the mean (or, with a ``group`` column of pre and qa, the difference of their means) and its 95 %
    interval. Draws are dealt to tasks; each has a generator of its own number, so results don't depend on the tasks.

    A draw with replacement is a multinomial draw of the distinct values' counts, so what goes to the tasks are distinct
    values: scores, of which there may be MAX_VALUES. The generator is numpy's, so the interval differs from another
    generator's by chance.
    """
    spark = values.sparkSession
    rows = values.filter(F.col(value).isNotNull()).groupBy((F.lit("all") if group is None else F.col(group)).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    found = rows.limit(MAX_VALUES + 1).toPandas().sort_values(["g", "v"])
    if len(found) > MAX_VALUES:
        raise ContractError(f"over {MAX_VALUES} distinct values")
    sides = {k: (x.v.to_numpy(), x.n.to_numpy()) for k, x in found.groupby("g")}
    wanted = ["all"] if group is None else ["pre", "qa"]
    if any(k not in sides for k in wanted):
        return spark.createDataFrame([(None, None, None, 0)], "estimate double, low double, high double, draws int")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch.id:
                rng = np.random.default_rng([seed, int(k)])
                means = [(rng.multinomial(n.sum(), n / n.sum()) @ v) / n.sum() for v, n in (sides[s] for s in wanted)]
                out.append(means[-1] - (means[0] if group else 0.0))
            yield pd.DataFrame({"m": out})

    drawn = spark.range(0, draws, 1, tasks).mapInPandas(draw, "m double")
    ordered = drawn.agg(F.array_sort(F.collect_list("m")).alias("m"))  # as many numbers as draws
    mean = {s: float(v @ n / n.sum()) for s, (v, n) in sides.items()}
    point = mean[wanted[-1]] - (mean[wanted[0]] if group else 0.0)
    return ordered.select(F.lit(point).alias("estimate"), F.get("m", F.lit(int(0.025 * draws))).alias("low"), F.get("m", F.lit(min(draws - 1, int(0.975 * draws)))).alias("high"), F.size("m").alias("draws"))


def hc3(rows: DataFrame, terms: dict[str, Column], y: Column) -> tuple[np.ndarray, np.ndarray, int] | None:
    """M-9: coefficients, their HC3 covariance and n; None where rank, freedom, variation or leverage leave it undefined.

    Two passes of sums that Spark adds up map side: the products of the terms, then the outer products weighted by each
    row's squared residual over 1 minus its leverage. What comes to the driver are matrices of the terms' number.
    """
    k = len(terms)
    named = rows.select(*[t.cast("double").alias(f"x{i}") for i, t in enumerate(terms.values())], y.cast("double").alias("y"))
    x = [F.col(f"x{i}") for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    first = named.agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in upper], *[F.sum(x[i] * F.col("y")).alias(f"q{i}") for i in range(k)]).first()
    if first.n <= k or first.lo == first.hi:
        return None
    products = np.array([[first[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    if np.linalg.matrix_rank(products, hermitian=True) < k:
        return None
    inverse = np.linalg.pinv(products, hermitian=True)
    beta = inverse @ np.array([first[f"q{i}"] for i in range(k)])
    total = lambda parts: sum(parts[1:], parts[0])
    leverage = total([x[i] * x[j] * float(inverse[i, j] * (1 if i == j else 2)) for i, j in upper])
    weighted = named.withColumn("h", leverage).withColumn("e", F.col("y") - total([x[i] * float(b) for i, b in enumerate(beta)]))
    square = F.pow(F.try_divide(F.col("e"), 1 - F.col("h")), F.lit(2))
    second = weighted.withColumn("w", square).agg(F.max("h").alias("h"), *[F.sum(x[i] * x[j] * F.col("w")).alias(f"m{i}_{j}") for i, j in upper]).first()
    if second.h >= 1 - 1e-8:
        return None
    middle = np.array([[second[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return beta, inverse @ middle @ inverse, first.n


def length_regression(units: DataFrame, interaction: bool = False) -> DataFrame:
    """M-9: score on section, log words (centred at REFERENCE_WORDS) and its square, and periods; a row for each term
    with estimate, HC3 error, interval and normal p; no rows where it is undefined."""
    spark = units.sparkSession
    rows = units.filter("score is not null and words > 0").select("section", F.col("period_bin").cast("string").alias("period_bin"), F.col("words").cast("double").alias("words"), F.col("score").cast("double").alias("score"))
    schema = "term string, estimate double, hc3_standard_error double, ci95_low double, ci95_high double, normal_approx_p double, n long"
    known = rows.agg(F.collect_set("section").alias("sections"), F.array_sort(F.collect_set("period_bin")).alias("periods")).first()  # names of sections and periods
    if set(known.sections) != {"PRE", "Q&A"}:
        return spark.createDataFrame([], schema)
    qa, size = F.when(F.col("section") == "Q&A", 1.0).otherwise(0.0), F.log(F.col("words") / REFERENCE_WORDS)
    terms = {"intercept_pre_at_140_words": F.lit(1.0), "qa_indicator": qa, "log_words_centered": size, "log_words_centered_squared": size * size}
    if interaction:
        terms["qa_x_log_words_centered"] = qa * size
    terms |= {f"period_{p}": F.when(F.col("period_bin") == p, 1.0).otherwise(0.0) for p in known.periods[1:]}
    fitted = hc3(rows, terms, F.col("score"))
    if fitted is None:
        return spark.createDataFrame([], schema)
    beta, covariance, n = fitted
    errors = np.sqrt(np.maximum(np.diag(covariance), 0))
    out = [(name, float(b), float(e), float(b - 1.96 * e), float(b + 1.96 * e), math.erfc(abs(b / e) / math.sqrt(2)) if e else None, n) for name, b, e in zip(terms, beta, errors, strict=True)]
    return spark.createDataFrame(out, schema)
