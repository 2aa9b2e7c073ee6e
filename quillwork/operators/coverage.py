"""Calls against tenures: an interval join on an equi key, and its ladders (J-2, C-4, P-8, A-8, A-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import first_reason
from quillwork.operators.tenure import EXACT

# Statuses of the issuer match and of the coverage.
ISSUER_EXACT = "exact_cusip8_single_gvkey"
COVERED_EXACT, COVERED_REVIEW = "covered_exact_ceo_tenure", "covered_review_ceo_tenure"


def cover(calls: DataFrame, tenures: DataFrame) -> DataFrame:
    """Every call (event_id, event_date, key) with its issuer and coverage status and the one tenure that covers it.

    ``tenures`` has key, gvkey, execid, tenure_episode, start_date, end_date, normalization_status. Both ends of a
    tenure are in it. The join is on the key only, with the dates counted after it, so unmatched calls stay; it is
    summed up by call before anything else, and a firm has few tenures. An ambiguous issuer outranks any coverage.
    """
    right = tenures.select(F.col("key").alias("__key"), F.coalesce("gvkey", F.lit("")).alias("__gvkey"), F.struct("execid", "tenure_episode", "start_date", "end_date", "normalization_status").alias("__tenure"))
    joined = calls.select("event_id", "event_date", F.coalesce("key", F.lit("")).alias("key")).join(right, (F.col("key") == F.col("__key")) & (F.col("key") != ""), "left")
    covers = F.col("event_date").between(F.col("__tenure.start_date"), F.col("__tenure.end_date"))
    grouped = joined.groupBy("event_id", "event_date", "key").agg(
        F.count("__key").alias("candidates"), F.count_distinct("__gvkey").alias("gvkeys"), F.count_if(F.col("__gvkey") == "").alias("blank_gvkeys"),
        F.min("__gvkey").alias("any_gvkey"), F.count_if(covers).alias("covering"), F.min(F.when(covers, F.col("__tenure"))).alias("t"),
    )
    issuer = first_reason(
        (F.col("key") == "", "no_ccts_cusip"), (F.col("candidates") == 0, "no_execucomp_cusip8_match"), (F.col("blank_gvkeys") > 0, "review_missing_execucomp_gvkey"),
        (F.col("gvkeys") == 1, ISSUER_EXACT), default="ambiguous_cusip8_multiple_gvkeys",
    )
    status = first_reason(
        (F.col("candidates") == 0, "not_testable_no_issuer_match"), (F.col("issuer_match_status") != ISSUER_EXACT, "review_ambiguous_issuer_match"),
        (F.col("event_date").isNull(), "review_missing_event_date"), (F.col("covering") == 0, "issuer_match_no_ceo_date_coverage"),
        (F.col("covering") > 1, "review_multiple_ceos_cover_event"), (F.col("t.normalization_status") == EXACT, COVERED_EXACT), default=COVERED_REVIEW,
    )
    confidence = first_reason(
        (F.col("ceo_coverage_status") == COVERED_EXACT, "high"), (F.col("ceo_coverage_status") == COVERED_REVIEW, "medium"),
        (F.col("ceo_coverage_status").isin("review_ambiguous_issuer_match", "review_multiple_ceos_cover_event"), "review"), default="unmatched",
    )
    out = grouped.withColumn("issuer_match_status", issuer).withColumn("ceo_coverage_status", status).withColumn("match_confidence", confidence)
    one = lambda c: F.when(F.col("covering") == 1, F.col(f"t.{c}"))
    return out.select(
        "event_id", "event_date", "key", "issuer_match_status", F.when(F.col("issuer_match_status") == ISSUER_EXACT, F.col("any_gvkey")).alias("gvkey"), "ceo_coverage_status",
        F.col("covering").alias("ceo_candidate_count"), one("execid").alias("execid"), one("tenure_episode").alias("tenure_episode"), one("start_date").alias("start_date"),
        one("end_date").alias("end_date"), one("normalization_status").alias("normalization_status"), "match_confidence",
    )


def exact_panel(covered: DataFrame) -> DataFrame:
    """P-8: calls with one exact tenure of one issuer."""
    exact = (F.col("issuer_match_status") == ISSUER_EXACT) & (F.col("ceo_coverage_status") == COVERED_EXACT) & (F.col("normalization_status") == EXACT)
    return covered.filter(exact & (F.col("ceo_candidate_count") == 1) & (F.coalesce("gvkey", F.lit("")) != ""))


def by_year(covered: DataFrame) -> DataFrame:
    """A-8: calls by year, those covered exactly, for review and at all, with percent."""
    counted = covered.groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("calls"), F.count_if(F.col("ceo_coverage_status") == COVERED_EXACT).alias("covered_exact"), F.count_if(F.col("ceo_coverage_status") == COVERED_REVIEW).alias("covered_review"))
    any_ = F.col("covered_exact") + F.col("covered_review")
    return counted.withColumn("covered_any", any_).withColumn("covered_any_pct", F.round(F.try_divide(F.lit(100.0) * any_, F.col("calls")), 4))


def summary(covered: DataFrame) -> DataFrame:
    """A-9: one row of distinct firms, episodes and keys, and the range of dates."""
    return covered.agg(
        F.count("*").alias("calls"), F.count_distinct("gvkey").alias("firms"), F.count_distinct(F.when(F.col("execid").isNotNull(), F.struct("gvkey", "execid", "tenure_episode"))).alias("episodes"),
        F.count_distinct(F.nullif("key", F.lit(""))).alias("cusips"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
    )
