"""Statistics that are null where they are undefined (M-2 to M-6, W-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.ranges import sums_before

CATEGORIES = 5


def pearson(x: Column, y: Column) -> Column:
    """M-4: null for fewer than two pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(c: str, *partition: str) -> Column:
    """W-7: ranks from 1 in which ties share their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, c)) - 1) / 2


def rank_table(df: DataFrame, column: str, to: str) -> DataFrame:
    """W-7 for a whole table without one task that sorts all of it: ranks of the distinct values, joined back.

    The values' counts are summed up first, and then over ranges of values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranks = sums_before(counts, column, __before=F.col("__n")).select(F.col(column).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / 2).alias(to))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """M-5: one row, spearman: Pearson of the average ranks over rows with both values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return rank_table(rank_table(both, x, "__rx"), y, "__ry").agg(pearson(F.col("__rx"), F.col("__ry")).alias("spearman"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, quadratic: bool, by: list[str] | None = None) -> DataFrame:
    """M-6: one row (for each ``by``), n and kappa over categories 1 to CATEGORIES; null without expected disagreement.

    Works on the table of counts, of CATEGORIES squared rows at most.
    """
    by = by or []
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    distance = lambda i, j: F.pow(F.abs(i - j) / (CATEGORIES - 1), F.lit(2 if quadratic else 1))
    observed = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * distance(F.col("i"), F.col("j"))).alias("observed"), F.collect_list(F.struct("i", "j", "n")).alias("cells"))
    rows = F.transform(F.sequence(F.lit(1), F.lit(CATEGORIES)), lambda k: F.aggregate(F.filter("cells", lambda c: c["i"] == k), F.lit(0).cast("long"), lambda s, c: s + c["n"]))
    cols = F.transform(F.sequence(F.lit(1), F.lit(CATEGORIES)), lambda k: F.aggregate(F.filter("cells", lambda c: c["j"] == k), F.lit(0).cast("long"), lambda s, c: s + c["n"]))
    terms = [F.col("rows")[i] * F.col("cols")[j] * (abs(i - j) / (CATEGORIES - 1)) ** (2 if quadratic else 1) for i in range(CATEGORIES) for j in range(CATEGORIES) if i != j]
    marginal = observed.withColumns({"rows": rows, "cols": cols}).withColumn("expected", sum(terms[1:], terms[0]) / F.col("n"))
    return marginal.select(*by, "n", (F.lit(1.0) - F.try_divide(F.col("observed"), F.when(F.col("expected") != 0, F.col("expected")))).alias("kappa"))


def percent(part: Column, whole: Column, places: int) -> Column:
    """M-2: rounded percent with a denominator of at least 1."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), places)


def finite(c: Column) -> Column:
    """M-10: null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def strict_int(c: Column, least: int = 0) -> Column:
    """M-1: an integer of at least ``least`` from text; an error for anything else."""
    n = F.when(F.trim(c).rlike(r"\A[+-]?\d+\z"), F.trim(c).try_cast("long"))
    return F.when(n >= least, n).otherwise(F.raise_error(F.concat(F.lit("not an integer in range: "), F.coalesce(c, F.lit("null")))))


def optional_int(c: Column) -> Column:
    """M-1: an integer, or null for blank and anything else."""
    return F.trim(c).try_cast("long")
