"""Event census: sections, roles, participants, waterfall, yearly rollups (SRC-1, SRC-2, SRC-13, A-1 to A-6, J-1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.roles import SIGNALS
from quillwork.functions.stats import percent


def metadata(events: DataFrame, event_type: str, min_year: int, limit: int | None = None) -> DataFrame:
    """SRC-1: events of a type from a year on, ordered by start and id, limited after the sort."""
    found = events.filter((F.col("event_type") == event_type) & (F.year("start_date") >= min_year)).orderBy("start_date", "event_id")
    return found if limit is None else found.limit(limit)


def select_ids(events: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-2: the events of an id list, sorted and limited over all of them."""
    found = events.join(ids.select("event_id").distinct(), "event_id", "left_semi").orderBy("start_date", "event_id")
    return found if limit is None else found.limit(limit)


def waterfall(events: DataFrame, steps: list[tuple[str, Column]], limit: int | None = None, order: tuple[str, ...] = ("start_date", "event_id")) -> DataFrame:
    """SRC-13: step, step_order and the rows that it excludes: the first condition that a row meets; then the limit.

    A row for the input, each step, those eligible and those over the limit, also where it excludes none.
    """
    reason = reduce(lambda c, s: c.when(s[1], s[0]), steps, F).otherwise("eligible")
    counts = events.agg(F.count("*").alias("input"), *[F.count_if(reason == name).alias(name) for name in [n for n, _ in steps] + ["eligible"]])
    names = ["input", *[n for n, _ in steps], "eligible"]
    cells = [F.struct(F.lit(k).alias("step_order"), F.lit(n).alias("step"), F.col(n).alias("rows")) for k, n in enumerate(names)]
    if limit is not None:
        cells.append(F.struct(F.lit(len(names)).alias("step_order"), F.lit("over_limit").alias("step"), F.greatest(F.col("eligible") - limit, F.lit(0).cast("long")).alias("rows")))
    return counts.select(F.inline(F.array(*cells)))


def section_counts(turns: DataFrame) -> DataFrame:
    """A-1: rows of each event by section; all but PRE and Q&A, null too, is other; the kinds there are as a set."""
    pre, qa = F.col("section") == "PRE", F.col("section") == "Q&A"
    counted = turns.groupBy("event_id").agg(F.count("*").alias("total_rows"), F.count_if(pre).alias("pre_rows"), F.count_if(qa).alias("qa_rows"))
    counted = counted.withColumn("other_rows", F.col("total_rows") - F.col("pre_rows") - F.col("qa_rows"))
    kinds = F.array_compact(F.array(*[F.when(F.col(c) > 0, n) for c, n in (("pre_rows", "PRE"), ("qa_rows", "Q&A"), ("other_rows", "OTHER"))]))
    return counted.withColumns({"kind_count": F.size(kinds).cast("long"), "kinds": F.array_join(kinds, ";")})


def census(events: DataFrame, turns: DataFrame) -> DataFrame:
    """J-1, A-4: every event with its counts; measured zero where the scan of turns found none, and the flags."""
    counts = section_counts(turns)
    joined = events.select("event_id").join(counts, "event_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_rows", "pre_rows", "qa_rows", "other_rows", "kind_count")} | {"kinds": F.coalesce("kinds", F.lit(""))}
    has_pre, has_qa = F.col("pre_rows") > 0, F.col("qa_rows") > 0
    flags = {"has_pre": has_pre, "has_qa": has_qa, "has_both": has_pre & has_qa, "pre_only": has_pre & ~has_qa, "qa_only": has_qa & ~has_pre, "no_text": F.col("total_rows") == 0}
    return joined.withColumns(zero).withColumns(flags)


def role_signals(turns: DataFrame, label: str = "label") -> DataFrame:
    """A-2: rows of each event by section and role signal, in one pass."""
    aggregates = [F.count_if((F.col("section") == s) & f(F.col(label))).alias(f"{p}_{name}_rows") for s, p in (("PRE", "pre"), ("Q&A", "qa")) for name, f in SIGNALS.items()]
    return turns.groupBy("event_id").agg(*aggregates)


def encoded_as_pre(pre_only: Column, pre_analyst_rows: Column, pre_operator_rows: Column) -> Column:
    """A presentation that may hold its question part: analysts, or more than one operator turn."""
    return pre_only & ((pre_analyst_rows > 0) | (pre_operator_rows > 1))


def participant_counts(events: DataFrame, participants: DataFrame) -> DataFrame:
    """A-3, A-4: rows, rows with a type, rows with a name and role signals (in either) of each event; zero if none."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    aggregates = [F.count("*").alias("participant_rows"), F.count_if(filled("participant_type")).alias("typed_rows"), F.count_if(filled("participant_name")).alias("named_rows")]
    aggregates += [F.count_if(f(F.col("participant_name")) | f(F.col("participant_type"))).alias(f"{n}_rows") for n, f in SIGNALS.items()]
    counted = participants.groupBy("event_id").agg(*aggregates)
    joined = events.select("event_id").join(counted, "event_id", "left")
    return joined.select("event_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted.columns[1:]])


def by_year(census_rows: DataFrame, flags: list[str], year: str = "year") -> DataFrame:
    """A-5: events, and each flag's count and percent, by year."""
    aggregates = [F.count("*").alias("events")]
    for f in flags:
        aggregates += [F.count_if(F.col(f)).alias(f)]
    counted = census_rows.groupBy(year).agg(*aggregates)
    return counted.withColumns({f"{f}_pct": percent(F.col(f), F.col("events"), 2) for f in flags})


def category_counts(df: DataFrame, by: str, columns: dict[str, list[str]]) -> DataFrame:
    """A-6, A-7: counts of the listed values of each column by ``by``, as columns."""
    aggregates = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in columns.items() for v in values]
    return df.groupBy(by).agg(F.count("*").alias("rows"), *aggregates)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """A-7: one row with the counts of a column's values as a map, which grows with the distinct values only."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).count()
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count")))).alias("counts"))
