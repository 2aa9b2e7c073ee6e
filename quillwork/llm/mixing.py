"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.skew import join_counted
from quillwork.storage import written

_HEX_DIGITS = 13
BROADCAST_SOURCES = 20_000
#: exp(-rate) is a normal double up to here; a higher rate is drawn in equal parts.
PART_RATE = 700.0
COPIES_AT_ONCE = 1000


def uniform(doc_id: Column, seed: int, salt: str, *more: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed, a salt, the id and more, the same on every run and engine."""
    text = F.concat_ws("|", F.lit(f"{seed}|{salt}"), F.coalesce(doc_id.cast("string"), F.lit("null")), *more)
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("long").cast("double") / float(1 << (4 * _HEX_DIGITS))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None) -> DataFrame:
    """source and its mean repetitions: target weight times all rows, divided by the weights' sum and its rows.

    The number of rows stays that of ``docs`` on average. Without ``weights`` all sources get the same weight; with
    them, a source that they don't name has weight 0, and a named one without rows is left out of the sum. A null
    source is a source of its own, named ''.
    """
    named = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = docs.groupBy(named.alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        given = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(float(w)).alias("weight")) for k, w in weights.items()])
        target = docs.sparkSession.range(1).select(F.inline(given))
        weighted = counts.join(F.broadcast(target), "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))  # as many rows as the parameter names
    weighted = written(weighted, "source-counts")
    total = weighted.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    if not total.weights:
        return weighted.select("source", F.lit(0.0).alias("rate"), "n")
    share = F.col("weight") * F.lit(float(total.rows)) / (F.lit(total.weights) * F.col("n"))
    return weighted.select("source", share.alias("rate"), "n")


def cumulative(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ..., until what is left out is below the hash's resolution."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * rate / k)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["sums"])


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, seed: int = 7, max_rate: float | None = None) -> DataFrame:
    """Every row of ``docs`` as often as its draw says (0 times or more), with ``copy`` (from 1) and ``shuffle_key``.

    The draw inverts the Poisson distribution whose mean is the source's rate at a number hashed from seed and id, so
    it needs no state, and a lost task draws the same again. A rate above PART_RATE is split into equal parts under it;
    the sum of the parts' independent draws has the same distribution. Rows go to random partitions and stand there in
    random order: the hash of seed, id and copy decides the order, and it and a hash of the row the partition, so that
    rows of one id are spread. Rows that repeat an id share its draw; a null id is
    replaced by a hash of all columns, so only rows without id that are alike in full share one. An empty table gives
    no rows. Any rate is drawn; only a caller who gives ``max_rate`` has rates above it refused.
    Columns named like the two new ones or starting with __ are replaced.
    """
    of_source = rates(docs, source_col, weights)
    if max_rate is not None:
        of_source = of_source.withColumn("rate", F.when(F.col("rate") <= max_rate, F.col("rate")).otherwise(F.raise_error(F.lit("a source's repetition rate is above max_rate"))))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("long")
    table = of_source.select(F.col("source").alias("__source"), parts.alias("__parts"), cumulative(F.col("rate") / parts).alias("__sums"), "n")
    of_row = F.concat(F.lit("null|"), F.md5(F.to_json(F.struct(*docs.columns))))
    named = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("string"), of_row)).withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    rows = of_source.agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.max("rate").alias("most")).first()

    def joined(part: DataFrame) -> DataFrame:
        if rows.sources <= BROADCAST_SOURCES:
            return named.join(F.broadcast(part.drop("n")), "__source")
        return join_counted(named, part, "__source", rows.rows)

    in_parts = (rows.most or 0.0) > PART_RATE
    u = uniform(F.col("__id"), seed, "count")
    times = F.size(F.filter("__sums", lambda x: x <= F.col("__u")))
    counted = joined(table.filter("__parts = 1") if in_parts else table).withColumn("__u", u).withColumn("__times", times).filter("__times > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__source", "__parts", "__sums", "__u", "__times")
    if in_parts:
        copies = copies.unionByName(_many_copies(joined(table.filter("__parts > 1")), "__id", seed))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), F.col("__id"), F.col("copy")))).drop("__id")
    return keyed.repartition("shuffle_key", F.xxhash64(*[F.col(f"`{c}`") for c in keyed.columns])).sortWithinPartitions("shuffle_key")


def _many_copies(joined: DataFrame, id_col: str, seed: int) -> DataFrame:
    """The copies of rows whose rate is in several parts; those of one row are dealt to tasks COPIES_AT_ONCE at a time."""
    us = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__parts")), lambda k: uniform(F.col(id_col), seed, "count", k.cast("string")))
    times = F.aggregate(us, F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter("__sums", lambda x: x <= u)))
    starts = F.when(F.col("__times") > 0, F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    begun = joined.withColumn("__times", times).drop("__source", "__parts", "__sums").withColumn("__start", F.explode(starts))
    dealt = begun.repartition(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(id_col), F.col("__start"))
    numbers = F.sequence(F.col("__start") + 1, F.least(F.col("__start") + COPIES_AT_ONCE, F.col("__times")))
    return dealt.withColumn("copy", F.explode(numbers.cast("array<int>"))).drop("__times", "__start")
