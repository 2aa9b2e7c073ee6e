"""Turn retrieval and its audit (SRC-3, C-16, O-8, K-6, K-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import reasons


def section(c: Column) -> Column:
    """Anything but PRE and Q&A, null too, is OTHER."""
    return F.when(c.isin("PRE", "Q&A"), c).otherwise("OTHER")


def fetch_audit(manifest: DataFrame, turns: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """C-16: every event of the manifest (event_id, expected_pre_rows, expected_qa_rows; null is not expected) with its
    counts, in ``source`` too, and the problems there are."""
    counted = turns.groupBy("event_id").agg(F.count("*").alias("fetched_rows"), F.count_if(F.col("section") == "PRE").alias("fetched_pre_rows"), F.count_if(F.col("section") == "Q&A").alias("fetched_qa_rows"), F.count_distinct("sequence_id").alias("ids"))
    stored = (turns if source is None else source).groupBy("event_id").agg(F.count("*").alias("database_rows"), F.min("sequence_id").alias("database_min_sequence_id"), F.max("sequence_id").alias("database_max_sequence_id"))
    joined = manifest.join(counted, "event_id", "left").join(stored, "event_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fetched_rows", "fetched_pre_rows", "fetched_qa_rows", "ids", "database_rows")}
    joined = joined.withColumns(zero)
    notes = reasons(
        (F.col("fetched_rows") != F.col("database_rows"), "fetched_row_count_mismatch"), (F.col("database_rows") == 0, "no_database_text_rows"),
        (F.col("fetched_pre_rows") != F.col("expected_pre_rows"), "pre_count_mismatch"), (F.col("fetched_qa_rows") != F.col("expected_qa_rows"), "qa_count_mismatch"),
        (F.col("ids") != F.col("fetched_rows"), "duplicate_sequence_id"),
    )
    return joined.withColumn("fetch_notes", F.array_join(notes, ";")).withColumn("fetch_status", F.when(F.col("fetch_notes") == "", "ok").otherwise("review")).drop("ids")


def in_order(turns: DataFrame, ranks: DataFrame, ordinal: str = "sequence_id") -> DataFrame:
    """K-6, K-7: turns in the order of their event's assignment_rank, then their own; dealt out by ranges of ranks."""
    joined = turns.join(ranks.select("event_id", "assignment_rank"), "event_id")
    return joined.repartitionByRange("assignment_rank").sortWithinPartitions("assignment_rank", ordinal)
