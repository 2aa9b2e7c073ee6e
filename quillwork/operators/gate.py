"""Speaker identity in a call and the gates on it (N-1, N-2, J-8, C-6, A-12, A-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.names import ACCEPTED, best_match, relation
from quillwork.functions.roles import is_ceo, is_special_ceo
from quillwork.functions.text import clean, first_reason, join_turns, label, reasons, speaker_key, word_count

EPISODE = ["gvkey", "execid", "tenure_episode"]


def candidate_evidence(turns: DataFrame) -> DataFrame:
    """N-2: each speaker key of an event's section that is a CEO anywhere in it, with all labels that the key used there.

    ``turns`` has event_id, section, text_name. Grouped in two steps, so a section is never one group of rows.
    """
    keyed = turns.select("event_id", "section", speaker_key(F.col("text_name")).alias("speaker_key"), label(F.col("text_name")).alias("label"), is_ceo(F.col("text_name")).alias("ceo"))
    grouped = keyed.groupBy("event_id", "section", "speaker_key").agg(F.bool_or("ceo").alias("ceo"), F.array_sort(F.collect_set("label")).alias("labels"))
    return grouped.filter("ceo and speaker_key <> ''").drop("ceo")


def identity(evidence: DataFrame, expected: DataFrame) -> DataFrame:
    """J-8, C-6: every expected event (event_id, expected_ceo_name) with its candidates, status, flags and the gate.

    One shared key and no flag is ready; several Q&A candidates alone raise no flag. A ready call is confirmed if the
    expected name and a shared label are in an accepted relation.
    """
    entry = F.struct("speaker_key", "labels")
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, entry)))
    calls = evidence.groupBy("event_id").agg(side("PRE").alias("pre"), side("Q&A").alias("qa"))
    none = F.array().cast("array<struct<speaker_key:string,labels:array<string>>>")
    joined = expected.join(calls, "event_id", "left").withColumns({"pre": F.coalesce("pre", none), "qa": F.coalesce("qa", none)})
    keys = lambda c: F.transform(c, lambda e: e["speaker_key"])
    labels = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda e: e["labels"]))))
    joined = joined.withColumn("shared", F.array_sort(F.array_intersect(keys("pre"), keys("qa"))))
    of_shared = lambda c: F.filter(c, lambda e: F.array_contains("shared", e["speaker_key"]))
    joined = joined.withColumns({"pre_labels": labels("pre"), "qa_labels": labels("qa"), "shared_labels": labels(F.concat(of_shared("pre"), of_shared("qa")))})
    flags = reasons(
        (F.size("shared") == 0, "NO_SHARED_PRE_QA_CEO_LABEL"), (F.size("pre") > 1, "MULTIPLE_PRE_CEO_CANDIDATES"), (F.size("shared") > 1, "MULTIPLE_SHARED_CEO_CANDIDATES"),
        (F.exists(F.concat("pre_labels", "qa_labels"), is_special_ceo), "SPECIAL_CEO_TITLE"),
    )
    joined = joined.withColumn("flags", flags).withColumn("ready", (F.size("shared") == 1) & (F.size("flags") == 0))
    status = first_reason(
        (F.col("ready"), "exact_single_shared_speaker_key"), (F.size("shared") > 1, "multiple_shared_speaker_keys"), (F.size("pre") > 1, "review_side_multiple_ceo_candidates"),
        (F.array_contains("flags", "SPECIAL_CEO_TITLE"), "review_special_ceo_title"), default="review_or_no_shared_speaker_key",
    )
    name = F.col("expected_ceo_name")
    joined = joined.withColumns({f"{s}_match": best_match(name, F.col(f"{s}_labels")) for s in ("pre", "qa", "shared")})
    quality = {s: F.col(f"{s}_match.quality") for s in ("pre", "qa", "shared")}
    ok = {s: q.isin(*ACCEPTED) for s, q in quality.items()}
    external = first_reason(
        (F.col("ready") & ok["shared"], "confirmed_external_ceo_shared_pre_qa"), (F.col("ready") & (quality["shared"] == "same_initial_last_name_review"), "review_external_ceo_initial_last_name"),
        (F.col("ready"), "mismatch_external_ceo_vs_shared_speaker"), (ok["pre"] & ok["qa"], "review_external_ceo_present_both_sections_not_strict_shared"),
        (ok["pre"] | ok["qa"], "review_external_ceo_present_one_section"), default="not_confirmed_external_ceo_not_title_labelled",
    )
    shown = (
        F.when(F.col("ready"), quality["shared"]).when(ok["pre"] & ok["qa"], "both_sections_name_match").when(ok["pre"], quality["pre"]).when(ok["qa"], quality["qa"])
        .when(quality["shared"] != "no_match", quality["shared"]).when(quality["pre"] != "no_match", quality["pre"]).otherwise(quality["qa"])
    )
    return joined.select(
        *expected.columns, F.size("pre").alias("pre_ceo_candidate_count"), F.size("qa").alias("qa_ceo_candidate_count"), F.size("shared").alias("shared_ceo_candidate_count"),
        "pre_labels", "qa_labels", "shared_labels", F.col("shared").alias("shared_keys"), status.alias("within_call_identity_status"), F.col("ready").alias("within_call_identity_ready"),
        F.array_join(F.array_sort("flags"), ";").alias("identity_flags"), F.col("shared_match.labels").alias("matched_shared_labels"), shown.alias("external_name_match_quality"),
        external.alias("external_speaker_validation_status"), (external == "confirmed_external_ceo_shared_pre_qa").alias("event_speaker_gate_pass"),
    )


def label_array_ok(values: Column, display: Column) -> Column:
    """N-1: distinct, non-blank labels of one speaker key, shown joined by '; '."""
    one_key = F.size(F.array_distinct(F.transform(values, speaker_key))) == 1
    return (F.size(values) > 0) & F.forall(values, lambda v: F.trim(v) != "") & (F.size(F.array_distinct(values)) == F.size(values)) & one_key & (F.array_join(values, "; ") == display)


def episode_gate(events: DataFrame, min_calls: int = 5, min_quarters: int = 5, by: list[str] | None = None) -> DataFrame:
    """A-12: confirmed calls and quarters of each episode, the gate, and the statuses' counts as JSON."""
    by = by or EPISODE
    passed = F.col("event_speaker_gate_pass")
    counted = events.groupBy(*by).agg(F.count("*").alias("fetched_events"), F.count_if(passed).alias("confirmed_calls"), F.count_distinct(F.when(passed, F.col("calendar_quarter"))).alias("confirmed_distinct_quarters"))
    statuses = events.groupBy(*by, "external_speaker_validation_status").count().groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("external_speaker_validation_status", "count"))))).alias("speaker_status_counts_json"))
    gate = (F.col("confirmed_calls") >= min_calls) & (F.col("confirmed_distinct_quarters") >= min_quarters)
    return counted.join(statuses, by).withColumn("episode_analysis_gate_pass", gate)


def turnover_gate(pairs: DataFrame, gates: DataFrame) -> DataFrame:
    """A-13: turnovers with both sides' gates; a side without calls doesn't pass."""
    out = pairs.select("turnover_id", "gvkey", "old_execid", "old_tenure_episode", "new_execid", "new_tenure_episode")
    for s in ("old", "new"):
        side = gates.select(F.col("gvkey").alias("__g"), F.col("execid").alias("__x"), F.col("tenure_episode").alias("__t"), F.col("confirmed_calls").alias(f"{s}_confirmed_calls"), F.col("episode_analysis_gate_pass").alias(f"{s}_episode_gate_pass"))
        out = out.join(side, (F.col("gvkey") == F.col("__g")) & (F.col(f"{s}_execid") == F.col("__x")) & (F.col(f"{s}_tenure_episode") == F.col("__t")), "left").drop("__g", "__x", "__t")
        out = out.withColumns({f"{s}_confirmed_calls": F.coalesce(f"{s}_confirmed_calls", F.lit(0).cast("long")), f"{s}_episode_gate_pass": F.coalesce(f"{s}_episode_gate_pass", F.lit(False))})
    old, new = F.col("old_episode_gate_pass"), F.col("new_episode_gate_pass")
    status = first_reason((old & new, "pass_both_episodes"), (~old & ~new, "fail_both_episode_gates"), (~old, "fail_old_episode_gate"), default="fail_new_episode_gate")
    return out.withColumn("turnover_gate_status", status).withColumn("turnover_analysis_gate_pass", old & new)


def presentation(turns: DataFrame, calls: DataFrame, audits: DataFrame) -> DataFrame:
    """C-7, E-5: each call of ``calls`` (from ``identity``) with its shared speakers' texts by section, and the identity
    status that also asks for a usable block audit (event_id, event_audit_status)."""
    of = turns.join(calls.select("event_id", "shared_keys"), "event_id").filter(F.array_contains("shared_keys", speaker_key(F.col("text_name"))))
    said = F.struct(F.col("sequence_id").cast("long").alias("k"), F.coalesce("text_contents", F.lit("")).alias("t"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, said)))
    texts = of.groupBy("event_id").agg(side("PRE").alias("p"), side("Q&A").alias("q"))
    text = lambda c: join_turns(F.transform(c, lambda x: x["t"]))
    filled = lambda c: F.transform(F.filter(c, lambda x: clean(x["t"]) != ""), lambda x: x["k"])
    none = F.array().cast("array<struct<k:bigint,t:string>>")
    joined = calls.select("event_id", "shared_keys", "pre_ceo_candidate_count", F.filter(F.split("identity_flags", ";"), lambda f: f != "").alias("flags")).join(texts, "event_id", "left").join(audits.select("event_id", "event_audit_status"), "event_id", "left")
    joined = joined.withColumns({"p": F.coalesce("p", none), "q": F.coalesce("q", none), "audit": F.coalesce("event_audit_status", F.lit("missing_block_audit"))})
    flags = F.concat("flags", F.when(F.col("audit") != "usable", F.array(F.concat(F.lit("BLOCK_AUDIT_"), F.upper("audit")))).otherwise(F.array().cast("array<string>")))
    joined = joined.withColumns({"flags": F.array_sort(F.array_distinct(flags)), "pre_text": text("p"), "qa_text": text("q")})
    ready = (F.size("shared_keys") == 1) & (F.size("flags") == 0)
    status = first_reason((ready, "exact_single_shared_speaker_key"), (F.size("shared_keys") > 1, "multiple_shared_speaker_keys"), (F.col("pre_ceo_candidate_count") > 1, "review_side_multiple_ceo_candidates"), default="review_or_no_shared_speaker_key")
    return joined.select(
        "event_id", status.alias("identity_status"), F.array_join("flags", ";").alias("identity_flags"), ready.alias("strict_identity_ready"), F.size("p").alias("pre_ceo_turn_count"), F.size("q").alias("qa_ceo_turn_count"),
        word_count(F.col("pre_text")).alias("pre_ceo_word_count"), word_count(F.col("qa_text")).alias("qa_ceo_word_count"), filled("p").alias("pre_sequence_ids"), filled("q").alias("qa_sequence_ids"),
        F.col("pre_text").alias("ceo_presentation_text"), F.col("qa_text").alias("ceo_qa_text"),
    )


def pair_validation(rows: DataFrame) -> DataFrame:
    """C-8: each turnover (turnover_id, turnover_side, event_id, event_date, expected_execid, expected_ceo_name,
    external_speaker_validation_status) with the first check that it fails, or none."""
    old = F.col("turnover_side") == "old"
    side = lambda on, c: F.when(on, F.col(c))
    names = lambda on: F.collect_list(side(on, "expected_ceo_name"))
    grouped = rows.groupBy("turnover_id").agg(
        F.array_sort(F.collect_set(F.coalesce("turnover_side", F.lit("")))).alias("sides"), F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.count_if(F.col("event_id").isNull()).alias("no_event"),
        F.count_if(~F.coalesce(F.col("external_speaker_validation_status") == "confirmed_external_ceo_shared_pre_qa", F.lit(False))).alias("unconfirmed"),
        F.count_if(F.trim(F.coalesce(F.col("expected_execid").cast("string"), F.lit(""))) == "").alias("no_person"), F.collect_set(side(old, "expected_execid")).alias("old_ids"), F.collect_set(side(~old, "expected_execid")).alias("new_ids"),
        names(old).alias("old_names"), names(~old).alias("new_names"), F.count_if(F.col("event_date").isNull()).alias("no_date"), F.max(side(old, "event_date")).alias("old_last"), F.min(side(~old, "event_date")).alias("new_first"),
    )
    alike = lambda c: F.forall(F.array_distinct(c), lambda n: relation(F.get(F.array_sort(F.array_distinct(c)), F.lit(0)), n).isin(*ACCEPTED))
    reason = first_reason(
        (F.col("sides") != F.array(F.lit("new"), F.lit("old")), "missing_or_invalid_old_new_sides"), ((F.col("no_event") > 0) | (F.col("events") != F.col("rows")), "missing_or_duplicate_event_identity"),
        (F.col("unconfirmed") > 0, "unconfirmed_event_speaker"),
        ((F.col("no_person") > 0) | (F.size("old_ids") != 1) | (F.size("new_ids") != 1) | ~alike(F.col("old_names")) | ~alike(F.col("new_names")), "missing_or_inconsistent_side_ceo_identity"),
        (F.col("old_ids") == F.col("new_ids"), "same_executive_on_both_turnover_sides"), (F.col("no_date") > 0, "missing_or_invalid_side_dates"), (F.col("old_last") >= F.col("new_first"), "mislabelled_or_overlapping_side_dates"), default="",
    )
    return grouped.select("turnover_id", reason.alias("pair_review_reason")).withColumn("pair_validation_status", F.when(F.col("pair_review_reason") == "", "confirmed_both_sides").otherwise("review_or_mismatch"))


def with_gate(found: DataFrame, gates: DataFrame, version: str) -> DataFrame:
    """P-14: blocks with their call's gate columns."""
    columns = ["gvkey", "execid", "tenure_episode", "expected_ceo_name", "event_date", "calendar_quarter", "external_name_match_quality", "external_speaker_validation_status"]
    names = gates.select("event_id", *[F.col(c).alias("expected_execid" if c == "execid" else c) for c in columns if c in gates.columns], F.array_join("matched_shared_labels", "; ").alias("validated_ceo_speaker"), F.lit(version).alias("speaker_gate_version"))
    return found.join(names, "event_id")
