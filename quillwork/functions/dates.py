"""Dates: parsing, quarters, periods (D-1 to D-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Further date formats, tried after ISO dates.
FORMATS = ["M/d/yyyy", "yyyyMMdd", "dMMMyyyy", "d-MMM-yyyy"]


def iso_date(c: Column) -> Column:
    """D-1: the date that a text starts with, null if there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"\A(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def any_date(c: Column) -> Column:
    """D-2: ISO, then FORMATS; null for all else."""
    text = F.trim(F.coalesce(c, F.lit("")))
    tries = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f)).cast("date")) for p, f in zip((r"\A\d{1,2}/\d{1,2}/\d{4}\z", r"\A\d{8}\z", r"\A\d{1,2}[A-Za-z]{3}\d{4}\z", r"\A\d{1,2}-[A-Za-z]{3}-\d{4}\z"), FORMATS, strict=True)]
    return F.coalesce(iso_date(text), *tries)


def year_in(c: Column) -> Column:
    """D-3: the first 19xx or 20xx in a text, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(?:19|20)\d\d", 0), F.lit("")).cast("int")


def quarter_text(d: Column) -> Column:
    """D-1: YYYYQn."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def period_bin(year: Column, first: int, width: int = 6, bins: int = 4) -> Column:
    """D-5: first-last year of the bin; an error outside all of them."""
    k = F.floor((year - first) / width)
    low = F.lit(first) + k * width
    return F.when((k >= 0) & (k < bins), F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string"))).otherwise(F.raise_error(F.concat(F.lit("year outside all periods: "), year.cast("string"))))
