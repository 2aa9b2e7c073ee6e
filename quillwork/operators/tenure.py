"""Tenure episodes from annual roster rows (W-3, W-4, D-6, D-7, A-27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.dates import any_date


# Where a boundary comes from, and the status of an exact episode.
START_EXACT, START_BOUND = "becameceo_exact", "ceoann_year_lower_bound"
END_EXACT, END_BOUND, END_NEXT = "leftofc_exact", "ceoann_year_upper_bound", "next_ceo_becameceo_exact"
CONFLICT = "conflicting_or_invalid_source_boundary_review"
EXACT = "exact_tenure_dates"


def islands(rows: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """W-3: rows with their episode (from 1): a new one where the year is over one past the year before. Rows without
    a year go; rows of one year stay together."""
    w = Window.partitionBy(*keys).orderBy(year)
    previous = F.lag(year).over(w)
    fresh = F.when(previous.isNull() | (F.col(year) > previous + 1), 1).otherwise(0)
    sums = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.filter(F.col(year).isNotNull()).withColumn("__new", fresh)
    return marked.withColumn("tenure_episode", F.sum("__new").over(sums).cast("int")).drop("__new")


def _boundary(raw: str) -> tuple:
    """The distinct parsed dates of a raw column and the number of cells that can't be parsed."""
    blank = F.trim(F.coalesce(F.col(raw), F.lit(""))) == ""
    dates = F.collect_set(F.when(~blank, any_date(F.col(raw))))
    unparsed = F.count_if(~blank & any_date(F.col(raw)).isNull())
    return dates, unparsed


def episodes(roster: DataFrame, firm: str = "gvkey", person: str = "execid", year: str = "year", start: str = "becameceo", end: str = "leftofc") -> DataFrame:
    """One row for each (firm, person, episode): first and last year, rows, boundary dates with their sources, status.

    A boundary is exact if its cells hold one parsed date, an annual bound (1 January or 31 December) if they hold
    none. Cells that can't be parsed, differ, or lie outside the episode by over a year put both boundaries in review,
    and annual bounds in their place. An annual end becomes the exact start of the firm's next episode if that begins
    by the year after and not before this start.
    """
    keys = [firm, person, "tenure_episode"]
    numbered = islands(roster.filter(F.col(firm).isNotNull() & F.col(person).isNotNull()), [firm, person], year)
    start_dates, start_bad = _boundary(start)
    end_dates, end_bad = _boundary(end)
    grouped = numbered.groupBy(*keys).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("annual_rows"),
        start_dates.alias("__s"), start_bad.alias("__sb"), end_dates.alias("__e"), end_bad.alias("__eb"),
    )
    s, e = F.get("__s", F.lit(0)), F.get("__e", F.lit(0))
    conflict = (
        (F.col("__sb") > 0) | (F.col("__eb") > 0) | (F.size("__s") > 1) | (F.size("__e") > 1)
        | F.coalesce(F.year(s) > F.col("last_year") + 1, F.lit(False))
        | ((F.col("tenure_episode") > 1) & F.coalesce(F.year(s) < F.col("first_year") - 1, F.lit(False)))
        | F.coalesce(F.year(e) < F.col("first_year") - 1, F.lit(False))
    )
    source = lambda name, exact, bound: F.when(F.col("__conflict"), CONFLICT).when(F.size(name) == 1, exact).otherwise(bound)
    dated = grouped.withColumn("__conflict", conflict).select(
        *keys, "first_year", "last_year", "annual_rows",
        F.when(~F.col("__conflict") & (F.size("__s") == 1), s).otherwise(F.make_date("first_year", F.lit(1), F.lit(1))).alias("start_date"),
        F.when(~F.col("__conflict") & (F.size("__e") == 1), e).otherwise(F.make_date("last_year", F.lit(12), F.lit(31))).alias("end_date"),
        source("__s", START_EXACT, START_BOUND).alias("start_date_source"), source("__e", END_EXACT, END_BOUND).alias("end_date_source"),
    )
    return with_status(impute_ends(dated, firm, person))


def impute_ends(dated: DataFrame, firm: str, person: str) -> DataFrame:
    """W-4: annual ends that the firm's next episode's exact start replaces."""
    w = Window.partitionBy(firm).orderBy("first_year", "start_date", person, "tenure_episode")
    following = F.lead(F.struct("first_year", "start_date", "start_date_source")).over(w)
    take = (F.col("end_date_source") == END_BOUND) & (F.col("__next.start_date_source") == START_EXACT) & (F.col("__next.first_year") <= F.col("last_year") + 1) & (F.col("__next.start_date") >= F.col("start_date"))
    out = dated.withColumn("__next", following).withColumn("__take", F.coalesce(take, F.lit(False)))
    return out.withColumns({"end_date": F.when(F.col("__take"), F.col("__next.start_date")).otherwise(F.col("end_date")), "end_date_source": F.when(F.col("__take"), END_NEXT).otherwise(F.col("end_date_source"))}).drop("__next", "__take")


def with_status(dated: DataFrame) -> DataFrame:
    """D-7: conflict, then start after end, then exact on both sides, else annual bounds."""
    status = (
        F.when(F.col("start_date_source") == CONFLICT, "source_boundary_conflict_review")
        .when(F.col("start_date") > F.col("end_date"), "invalid_date_order_review")
        .when((F.col("start_date_source") == START_EXACT) & F.col("end_date_source").isin(END_EXACT, END_NEXT), EXACT)
        .otherwise("annual_flag_date_bounds")
    )
    return dated.withColumn("normalization_status", status)


def latest_value(value: str, year: str, ordinal: str):
    """A-27: the last year's value that is not blank; of one year, the first in file order."""
    filled = F.trim(F.coalesce(F.col(value), F.lit(""))) != ""
    return F.max_by(F.when(filled, F.col(value)), F.when(filled, F.struct(F.col(year), -F.col(ordinal))))


def distinct_values(value: str):
    """A-27: the distinct values that are not blank, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) != "", F.col(value)))), ";")
