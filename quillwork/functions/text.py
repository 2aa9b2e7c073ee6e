
from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms and articles that say nothing about a company's identity.
COMPANY_STOP_WORDS = "a ab ag and asa bhd bm co company corp corporation gmbh group holdings inc incorporated kk limited llc ltd nv oyj plc sa se spa the".split()

# What an event's title can end in after the company, longest variants first where one ends another.
TITLE_ENDINGS = [
    "earnings conference call", "international earnings conference call", "earnings call and analyst meeting", "earnings call",
    "earnings presentation and webcast", "earnings presentation & webcast", "earnings presentation", "earnings press conference",
    "results briefing", "analyst meeting", "conference call", "presentation and webcast", "presentation", "webcast",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the whole text matches; false for null."""
    return F.coalesce(c.rlike(("(?i)" if ignore_case else "") + rf"\A(?:{pattern})\z"), F.lit(False))


def has(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a part of the text matches; false for null."""
    return F.coalesce(c.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def clean(c: Column) -> Column:
    """T-1: Unicode white space collapsed to single spaces, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """T-2: lower case with runs of all but a-z and 0-9 as one space, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def word_count(c: Column) -> Column:
    """T-6: white-space tokens of the cleaned text; '' has none."""
    text = clean(c)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("long")


def sentences(c: Column) -> Column:
    """The normalised, non-empty pieces between full stops, exclamation and question marks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.!?]+"), norm), lambda p: p != "")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """T-3's entity decoding, for which Spark has no expression; null is ''."""
    return s.fillna("").map(html.unescape)


def token_text(c: Column) -> Column:
    """T-3: entities decoded, lower case, & as the word and, T-2."""
    return norm(F.replace(F.lower(html_unescape(c)), F.lit("&"), F.lit(" and ")))


def company_tokens(c: Column) -> Column:
    """T-4: the words of a company's name of two or more letters that are not legal forms, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in COMPANY_STOP_WORDS])
    return F.filter(F.split(token_text(c), " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def title_company(c: Column) -> Column:
    """T-5: what is left of an event's title as the company: periods before it, the kind of event and year after it go."""
    ordinal, year = "(?:first|second|third|fourth)", r"\d{4}"
    # What goes, in this order.
    steps = [
        (r"\A\s*[-–—:\t]+", ""),
        (rf"(?i)\A\s*(?:Q[1-4]|H[12]|FY)\s+{year}\s+", ""),
        (rf"(?i)\A\s*{ordinal}\s+quarter\s+{year}\s+", ""),
        (rf"(?i)\A\s*(?:half year|full year|interim|annual)\s+{year}\s+", ""),
        (rf"(?i)\A\s*{year}\s+{ordinal}\s+quarter\s+", ""),
        (r"\s*\([^)]*\)\s*\z", ""),
        *[(rf"(?i)\s+{ending}\s*\z", "") for ending in TITLE_ENDINGS],
        (rf"(?i)[’']s\s+fiscal\s+year\s+{year}.*\z", ""),
        (rf"(?i)\s+fiscal\s+year\s+{year}.*\z", ""),
        (rf"(?i)\s+{ordinal}\s+quarter\s+{year}\s*\z", ""),
        (rf"(?i)\s+q[1-4]\s+{year}\s*\z", ""),
        (r"(?i)\s+earnings\s+results\s*\z", ""),
        (r"\s+[-–—]\s+.*\z", ""),
    ]
    out = html_unescape(clean(c))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return clean(F.btrim(out, F.lit(" ,.-:;")))


def label(c: Column) -> Column:
    """T-7: a speaker label without its trailing [number]."""
    return F.trim(F.regexp_replace(clean(c), r"\s*\[\d+\]\s*\z", ""))


def left_of_dash(c: Column) -> Column:
    return F.split(c, r"\s+-\s+", 2)[0]


def right_of_dash(c: Column) -> Column:
    """What follows the first ' - ', null if there is none."""
    return F.get(F.split(c, r"\s+-\s+", 2), F.lit(1))


def speaker_key(c: Column) -> Column:
    """T-7: the label left of ' - ', normalised."""
    return norm(left_of_dash(label(c)))


def affiliation(c: Column) -> Column:
    """T-7: what follows the name's comma, without generation suffixes and ', Research Division'."""
    after = F.trim(F.coalesce(F.get(F.split(left_of_dash(label(c)), ",", 2), F.lit(1)), F.lit("")))
    after = F.regexp_replace(after, r"(?i)\A(?:Jr\.?|Sr\.?|II|III|IV),\s*", "")
    return F.trim(F.regexp_replace(after, r"(?i),\s*Research Division\z", ""))


def issuer_label(c: Column) -> Column:
    """T-8: the last comma part left of ' - '; '' without a comma."""
    left = left_of_dash(F.coalesce(c, F.lit("")))
    return F.when(left.contains(","), clean(F.element_at(F.split(left, ","), -1))).otherwise("")


def cusip8(c: Column) -> Column:
    """T-21: upper case letters and digits, the first eight; '' if there are fewer."""
    bare = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.when(F.length(bare) >= 8, F.substring(bare, 1, 8)).otherwise("")


def join_turns(texts: Column) -> Column:
    """T-20: the cleaned, non-empty texts of an array with an empty line between them."""
    return F.array_join(F.filter(F.transform(texts, clean), lambda t: t != ""), "\n\n")


def content_hash(*parts: Column) -> Column:
    """T-26: SHA-256 of the parts with a line break between them; null is ''."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def person_name(full: Column, first: Column, last: Column) -> Column:
    """T-27: the full name, or first and last."""
    return F.when(clean(full) != "", clean(full)).otherwise(clean(F.concat_ws(" ", clean(first), clean(last))))


def duration_text(seconds: Column) -> Column:
    """T-25: whole seconds (half to even, none below 0) as hours and minutes, minutes and seconds, or seconds."""
    n = F.greatest(F.lit(0), F.bround(seconds.cast("double"), 0).cast("long"))
    hours, minutes, rest = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    long = F.format_string("%dh %02dm", hours, minutes)
    return F.when(hours > 0, long).when(minutes > 0, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def ratio_text(numerator: Column, denominator: Column) -> Column:
    """T-23: a ratio with three decimals, '' if the denominator isn't positive."""
    shown = F.regexp_replace(F.format_number(F.try_divide(numerator.cast("double"), denominator.cast("double")), 3), ",", "")
    return F.when(denominator > 0, shown).otherwise("")


def set_text(values: Column) -> Column:
    """A set of strings as one cell: distinct, not empty, sorted, joined by ';'."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))), ";")


def text_set(c: Column) -> Column:
    """N-4: the set in a cell that ``set_text`` made."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda v: v != ""))


def first_reason(*cases: tuple[Column, str], default: str) -> Column:
    """A ladder: the name of the first condition that holds."""
    out: Callable | Column = F
    for condition, name in cases:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


def reasons(*cases: tuple[Column, str]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in cases]))
