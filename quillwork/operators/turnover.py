"""Call sequences, turnovers and the candidate manifest (J-3 to J-6, W-1, W-2, W-5, W-6, C-5, A-10, A-11, L-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.ranges import sums_before
from quillwork.functions.dates import quarter_text
from quillwork.functions.text import first_reason, reasons
from quillwork.operators.tenure import EXACT

EPISODE = ["gvkey", "execid", "tenure_episode"]
SUPPORT = 5


def panel_violations(panel: DataFrame, tenures: DataFrame) -> DataFrame:
    """J-3: calls that match no tenure or several, with other dates, outside it, not exact, or that repeat."""
    t = tenures.groupBy(*[F.col(k).alias(f"t_{k}") for k in EPISODE]).agg(F.count("*").alias("matches"), F.min("start_date").alias("t_start"), F.min("end_date").alias("t_end"), F.min("normalization_status").alias("t_status"))
    on = [F.col(k) == F.col(f"t_{k}") for k in EPISODE]
    joined = panel.select("event_id", "event_date", "start_date", "end_date", *EPISODE).distinct().join(t, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    repeated = panel.groupBy("event_id").count().filter("count > 1").select(F.col("event_id").alias("again"))
    joined = joined.join(repeated, F.col("event_id") == F.col("again"), "left")
    why = reasons(
        (F.col("again").isNotNull(), "duplicate_call"), (F.col("matches") == 0, "no_roster_row"), (F.col("matches") > 1, "several_roster_rows"), (F.col("t_status") != EXACT, "nonexact_roster_row"),
        ((F.col("t_start") != F.col("start_date")) | (F.col("t_end") != F.col("end_date")), "boundary_changed"), (~F.col("event_date").between(F.col("t_start"), F.col("t_end")), "date_outside_tenure"),
    )
    return joined.select("event_id", F.array_join(why, ";").alias("violations")).filter("violations <> ''")


def call_sequences(panel: DataFrame) -> DataFrame:
    """W-1, W-2, A-10: each call's place in its episode, gaps to its neighbours and the episode's support.

    Calls of a day are in the order of their id as text.
    """
    whole = Window.partitionBy(*EPISODE)
    order = whole.orderBy("event_date", F.col("event_id").cast("string"))
    quarter = quarter_text(F.col("event_date"))
    quarters = F.size(F.collect_set(quarter).over(whole))
    calls = F.count(F.lit(1)).over(whole)
    return panel.select(
        *EPISODE, "event_id", "event_date", quarter.alias("calendar_quarter"), F.row_number().over(order).alias("call_index_in_episode"), calls.alias("calls_in_episode"), quarters.alias("distinct_quarters_in_episode"),
        F.datediff("event_date", "start_date").alias("days_since_ceo_start"), F.datediff("end_date", "event_date").alias("days_until_ceo_end"),
        F.datediff("event_date", F.lag("event_date").over(order)).alias("days_from_previous_call"), F.datediff(F.lead("event_date").over(order), "event_date").alias("days_to_next_call"),
        (calls >= SUPPORT).alias("has_at_least_5_calls"), (quarters >= SUPPORT).alias("has_at_least_5_distinct_quarters"),
    )


def episode_calls(panel: DataFrame) -> DataFrame:
    """A-10, W-6: calls, quarters, first and last call of each episode."""
    at = F.struct("event_date", F.col("event_id").cast("string"))
    return panel.groupBy(*EPISODE).agg(
        F.count("*").alias("calls"), F.count_distinct(quarter_text(F.col("event_date"))).alias("quarters"),
        F.min_by("event_id", at).alias("first_id"), F.min("event_date").alias("first_date"), F.max_by("event_id", at).alias("last_id"), F.max("event_date").alias("last_date"),
    )


def turnovers(tenures: DataFrame, panel: DataFrame, max_gap_days: int = 120) -> DataFrame:
    """J-4, J-5, W-5, C-5: a row for each pair of adjacent episodes of a firm with different persons.

    Numbers follow firm and order. They are counted over turnovers in ranges of firms: a window within each firm, plus
    the turnovers of the firms before it.
    """
    order = Window.partitionBy("gvkey").orderBy("start_date", "end_date", F.col("execid").cast("string"), F.col("tenure_episode").cast("string"))
    side = F.struct("execid", "tenure_episode", "start_date", "end_date", "normalization_status")
    pairs = tenures.select("gvkey", side.alias("old"), F.lead(side).over(order).alias("new"), F.row_number().over(order).alias("place")).filter("old.execid <> new.execid")
    within = Window.partitionBy("gvkey").orderBy("place")
    numbered = pairs.withColumn("k", F.row_number().over(within))
    firms = numbered.groupBy("gvkey").agg(F.count("*").alias("n"))
    before = sums_before(firms, "gvkey", before=F.col("n")).drop("n")
    ranked = numbered.join(before, "gvkey").withColumn("turnover_id", F.format_string("execucomp_turnover_%05d", F.col("before") + F.col("k")))
    calls = episode_calls(panel)
    for name in ("old", "new"):
        of = calls.select(F.col("gvkey").alias("__g"), F.col("execid").alias("__x"), F.col("tenure_episode").alias("__t"), F.struct("calls", "quarters", "first_id", "first_date", "last_id", "last_date").alias(f"{name}_c"))
        ranked = ranked.join(of, (F.col("gvkey") == F.col("__g")) & (F.col(f"{name}.execid") == F.col("__x")) & (F.col(f"{name}.tenure_episode") == F.col("__t")), "left").drop("__g", "__x", "__t")
    count = lambda side_, c: F.coalesce(F.col(f"{side_}_c.{c}"), F.lit(0).cast("long"))
    roster_gap = F.datediff("new.start_date", "old.end_date")
    roster = first_reason(((F.col("old.normalization_status") != EXACT) | (F.col("new.normalization_status") != EXACT), "review_nonexact_adjacent_tenure"), (roster_gap < 0, "review_overlapping_exact_tenures"), default="exact_adjacent_ceo_change")
    call_gap = F.datediff("new_c.first_date", "old_c.last_date")
    near = F.coalesce(call_gap.between(0, max_gap_days), F.lit(False))
    fives = (count("old", "quarters") >= SUPPORT) & (count("new", "quarters") >= SUPPORT)
    exact = F.col("roster_transition_status") == "exact_adjacent_ceo_change"
    window = (
        F.when(~exact, F.col("roster_transition_status"))
        .when((F.col("old_calls") == 0) & (F.col("new_calls") == 0), "exact_turnover_no_calls_either_side")
        .when(F.col("old_calls") == 0, "exact_turnover_no_old_ceo_call")
        .when(F.col("new_calls") == 0, "exact_turnover_no_new_ceo_call")
        .when(~F.col("within_call_gap"), "exact_turnover_call_gap_exceeds_120_days")
        .when(~F.col("five_quarters_each_side"), "exact_turnover_within_120_insufficient_5q_each_side")
        .otherwise("anchor_turnover_ready")
    )
    flat = ranked.select(
        "turnover_id", "gvkey", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("execid", "tenure_episode", "start_date", "end_date")], roster_gap.alias("roster_transition_gap_days"),
        roster.alias("roster_transition_status"), *[count(s, c).alias(f"{s}_{n}") for s in ("old", "new") for c, n in (("calls", "calls"), ("quarters", "distinct_quarters"))],
        F.col("old_c.last_id").alias("old_last_event_id"), F.col("old_c.last_date").alias("old_last_call_date"), F.col("new_c.first_id").alias("new_first_event_id"), F.col("new_c.first_date").alias("new_first_call_date"),
        call_gap.alias("call_gap_days"), near.alias("within_call_gap"), ((count("old", "calls") >= SUPPORT) & (count("new", "calls") >= SUPPORT)).alias("five_calls_each_side"), fives.alias("five_quarters_each_side"),
    )
    return flat.withColumn("turnover_window_status", window).withColumn("anchor_turnover_ready", exact & F.col("within_call_gap") & F.col("five_quarters_each_side"))


def episode_sides(pairs: DataFrame) -> DataFrame:
    """J-6: a row for each side of each turnover."""
    sides = [F.struct(F.lit(f"{s}_episode").alias("side"), F.col(f"{s}_execid").alias("execid"), F.col(f"{s}_tenure_episode").alias("tenure_episode"), F.col(f"{s}_calls").alias("pair_calls"), F.col(f"{s}_distinct_quarters").alias("pair_quarters")) for s in ("old", "new")]
    return pairs.select("turnover_id", "gvkey", F.inline(F.array(*sides)))


def candidate_episodes(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """A-11: each episode of a turnover with its turnovers, sides and calls, and whether both counts agree."""
    sides = episode_sides(pairs)
    of = sides.groupBy(*EPISODE).agg(F.array_join(F.array_sort(F.collect_set("turnover_id")), ";").alias("turnover_ids"), F.array_join(F.array_sort(F.collect_set("side")), ";").alias("roles"), F.max("pair_calls").alias("pair_calls"))
    calls = sequences.groupBy(*EPISODE).agg(F.count_distinct("event_id").alias("calls"), F.count_distinct("calendar_quarter").alias("quarters"))
    joined = of.join(calls, EPISODE, "left").withColumns({"calls": F.coalesce("calls", F.lit(0)), "quarters": F.coalesce("quarters", F.lit(0))})
    return joined.withColumn("counts_agree", F.col("calls") == F.col("pair_calls"))


def candidate_assignments(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """J-6: the calls of the turnovers' episodes, once each, with the turnovers that want them."""
    sides = episode_sides(pairs)
    of = sides.groupBy(*EPISODE).agg(F.array_join(F.array_sort(F.collect_set("turnover_id")), ";").alias("turnover_ids"))
    return sequences.join(of, EPISODE).select(*EPISODE, "event_id", "event_date", "calendar_quarter", "turnover_ids")


def rotation(counts: dict[str, int], n: int) -> list[tuple[str, int]]:
    """L-8: (stratum, place in it) of the first ``n`` picks of a rotation whose cursor runs modulo the strata left."""
    left, taken, cursor, out = sorted(k for k, v in counts.items() if v > 0), dict.fromkeys(counts, 0), 0, []
    while len(out) < n and left:
        stratum = left[cursor % len(left)]
        taken[stratum] += 1
        out.append((stratum, taken[stratum]))
        left = [k for k in left if taken[k] < counts[k]]
        cursor += 1
    return out


def round_robin(df: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """L-8: ``n`` rows by ``rotation`` over the strata, with audit_rank. Only counts by stratum come to the driver."""
    counts = {r[0]: r[1] for r in df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    picks = [(s, k, r) for r, (s, k) in enumerate(rotation(counts, n), start=1)]
    plan = df.sparkSession.createDataFrame(picks, f"`{stratum}` string, __k int, audit_rank int")
    placed = df.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return placed.join(F.broadcast(plan), [stratum, "__k"]).drop("__k")  # as many rows as n
