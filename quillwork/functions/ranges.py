"""Sums over all rows before a row, in ranges of the order, so that no task sorts or sums the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 16  # values looked at for each range


def range_number(df: DataFrame, key: str) -> Column:
    """The number of the range that a row's key is in: ranges follow the key's order and are about equal in distinct keys.

    The cuts are values of the key, picked by hash, so that the same rows give the same ranges whenever they are read;
    there are at most as many ranges as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(parts * SAMPLE)
    cuts = sorted(r[0] for r in some.collect())[SAMPLE // 2 :: SAMPLE]  # any order would do, this one makes ranges even
    if not cuts:
        return F.lit(0)
    kind = df.schema[key].dataType
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(key)))


def sums_before(df: DataFrame, key: str, **sums: Column) -> DataFrame:
    """``df``, of unique non-null keys, with the sums of the columns over all rows with a smaller key (0 for the first).

    Each range is summed by its own task; of the ranges before it, only their totals meet, a row for each.
    """
    names = list(sums)
    parts = df.withColumns({f"__v_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}).withColumn("__range", range_number(df, key))
    inner = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) for n in names})
    totals = parts.groupBy("__range").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in names])
    joined = within.join(F.broadcast(offsets), "__range")  # a row for each range
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__o_{n}")).alias(n) for n in names])
