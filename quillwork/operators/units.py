"""Scoring units, lanes and word ledgers (T-19, E-6, E-7, W-9, N-5, C-10 to C-12, A-15 to A-19, P-7, C-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import procedure
from quillwork.functions.roles import is_analyst, is_operator
from quillwork.functions.text import clean, first_reason, has, issuer_label, label, let, reasons, right_of_dash, speaker_key, word_count

MAX_WORDS, MIN_TAIL = 150, 50

# Flags that don't make a block doubtful, and the titles of managers.
BENIGN_FLAGS = ["SHORT_ANALYST_QUESTION", "SHORT_CEO_ANSWER", "ANALYST_ACKNOWLEDGEMENT_RETAINED_IN_CONTEXT", "OPERATOR_CLOSING_BOUNDARY"]
MANAGER_TITLES = r"\b(?:chief|CFO|COO|CTO|CMO|president|treasurer|controller|vice president|VP|EVP|SVP|director|head)\b"
LANES = ["primary", "management_context", "qa_coverage"]


def _words(c: Column) -> Column:
    """Words of a text that is clean already."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def chunks(c: Column, max_words: int = MAX_WORDS, min_tail: int = MIN_TAIL) -> Column:
    """T-19: the cleaned text in chunks of whole sentences, packed up to ``max_words``.

    Longer sentences are cut by words. A last chunk under ``min_tail`` words joins the one before, which may then be
    longer. The chunks joined by spaces are the cleaned text; '' has none.
    """
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / max_words).cast("int")), lambda k: F.array_join(F.slice(w, k * max_words + 1, max_words), " "))
    hard = lambda s: let(F.split(s, " "), cut)

    def pack(pieces: Column, counts: Column) -> Column:
        """The first piece of each chunk, packed over the counts alone; the texts are joined once, at the end."""
        start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))

        def step(state: Column, k: Column) -> Column:
            n = F.get(counts, k)
            fresh = (F.size(state["starts"]) == 0) | (state["n"] + n > max_words)
            return F.struct(F.when(fresh, F.concat(state["starts"], F.array(k))).otherwise(state["starts"]).alias("starts"), F.when(fresh, n).otherwise(state["n"] + n).alias("n"))

        def finish(state: Column) -> Column:
            some = F.size(state["starts"])
            return F.when((some > 1) & (state["n"] < min_tail), F.slice(state["starts"], 1, some - 1)).otherwise(state["starts"])

        starts = F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, finish)
        return let(starts, lambda at: F.transform(at, lambda begin, k: F.array_join(F.slice(pieces, begin + 1, F.coalesce(F.get(at, k + 1), F.size(pieces)) - begin), " ")))

    def long(text: Column) -> Column:
        sentences = F.filter(F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.when(_words(s) > max_words, hard(s)).otherwise(F.array(s)))), lambda s: s != "")
        return let(sentences, lambda pieces: let(F.transform(pieces, _words), lambda counts: pack(pieces, counts)))

    none = F.array().cast("array<string>")
    return let(clean(c), lambda text: F.when(text == "", none).when(_words(text) <= max_words, F.array(text)).otherwise(long(text)))


def pre_units(turns: DataFrame, id_cols: list[str], text: str = "text_contents") -> DataFrame:
    """E-6: a row for each chunk of each presentation turn, with its decision: proposed, review or procedural."""
    judged = turns.select(*id_cols, procedure.source_defects(F.col(text)).alias("r"), F.col(text).alias("__t"))  # once a turn, not a chunk
    cut = judged.select(*id_cols, "r", F.posexplode(chunks(F.col("__t"))).alias("__k", "segment"))
    out = cut.withColumn("d", procedure.content_decision(F.col("segment")))
    status = first_reason((F.size("r") > 0, "review"), (F.col("d.ready"), "proposed"), default="procedural")
    return out.select(*id_cols, (F.col("__k") + 1).alias("chunk_index"), word_count(F.col("segment")).alias("word_count"), F.col("d.content_class").alias("content_class"), F.col("d.content_reason").alias("content_reason"), F.array_join("r", ";").alias("source_review_reasons"), status.alias("unit_status"), "segment")


def chunk_violations(turns: DataFrame, units: DataFrame, id_cols: list[str], text: str = "text_contents") -> DataFrame:
    """Turns that their chunks don't give again."""
    again = units.groupBy(*id_cols).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "segment"))), lambda x: x["segment"]), " ").alias("__again"))
    return turns.join(again, id_cols, "left").filter(clean(F.col(text)) != F.coalesce("__again", F.lit(""))).select(*id_cols)


def qa_units(found: DataFrame) -> DataFrame:
    """E-7, N-5: each block with exclusion reasons (none: a unit) and the request's JSON."""
    why = F.concat(procedure.answer_exclusions(F.col("ceo_answer")), procedure.question_exclusions(F.col("analyst_question")), reasons((F.col("quality_tier") != "high", "not_high_tier")))
    request = F.to_json(F.struct(F.lit("qa").alias("unit_type"), F.col("analyst_question"), F.col("ceo_answer")))
    return found.select("block_id", "event_id", word_count(F.col("ceo_answer")).alias("unit_word_count"), word_count(F.col("analyst_question")).alias("question_word_count"), F.array_join(why, ";").alias("exclusion_reasons"), request.alias("prompt_input_json"))


def management_context(found: DataFrame, turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """P-7: block_id and whether all other speakers in its context are named managers of the anchor's issuer, and one is."""
    spoken = found.select("block_id", "event_id", F.explode("context_sequence_ids").alias("sequence_id")).join(turns.select("event_id", F.col("sequence_id").cast("long").alias("sequence_id"), "text_name"), ["event_id", "sequence_id"])
    joined = spoken.join(anchors.select("event_id", "shared_keys", "shared_labels"), "event_id")
    name = F.col("text_name")
    other = ~F.array_contains("shared_keys", speaker_key(name)) & ~is_analyst(name, F.col("shared_labels")) & ~is_operator(name)
    issuer, title = F.lower(issuer_label(F.get("shared_labels", F.lit(0)))), right_of_dash(label(name))
    manager = title.isNotNull() & (issuer != "") & (F.lower(issuer_label(label(name))) == issuer) & has(title, MANAGER_TITLES, True) & ~has(F.split(label(name), r"\s+-\s+", 2)[0], r"\bunidentified|unknown\b", True)
    return joined.groupBy("block_id").agg((F.bool_and(~other | manager) & F.bool_or(other)).alias("known_management_context"))


def classify_blocks(found: DataFrame, context: DataFrame) -> DataFrame:
    """C-10: each block's lanes, inclusion status and reason."""
    benign = F.array(*[F.lit(f) for f in BENIGN_FLAGS])
    with_management = F.array(*[F.lit(f) for f in [*BENIGN_FLAGS, "NON_CEO_MANAGEMENT_CONTEXT"]])
    doubts = F.concat(procedure.source_defects(F.col("ceo_answer")), F.transform(procedure.source_defects(F.col("analyst_question")), lambda r: F.concat(F.lit("question_"), r)), reasons((clean(F.col("analyst_question")) == "", "empty_question")))
    joined = found.join(context, "block_id", "left").withColumns({"d": procedure.content_decision(F.col("ceo_answer")), "doubts": doubts, "odd": F.array_except("block_flags", benign)})
    ready = F.col("d.ready") & (F.size("doubts") == 0)
    primary = ready & (F.col("quality_tier") == "high") & (F.size("odd") == 0)
    usable = ready & (F.col("quality_tier") == "usable_with_flag") & (F.size(F.array_except("block_flags", with_management)) == 0) & F.array_contains("block_flags", "NON_CEO_MANAGEMENT_CONTEXT")
    management = primary | (usable & F.coalesce("known_management_context", F.lit(False)))
    why = F.array_join(F.array_sort(F.array_union("doubts", "odd")), ";")
    status = first_reason((~F.col("d.ready"), "exclude_procedural_or_empty"), (primary, "proposed_primary"), (management, "sensitivity_only"), default="source_or_boundary_review")
    reason = F.when(~F.col("d.ready"), F.col("d.content_reason")).when(primary, "high_tier_source_screen_pass").when(management, "identified_same_issuer_management_context").when(why != "", why).otherwise("tier_requires_review")
    return joined.select("block_id", "event_id", F.col("ceo_answer_word_count").alias("words"), primary.alias("primary_block_candidate"), management.alias("management_context_block_candidate"), status.alias("inclusion_status"), reason.alias("inclusion_reason"))


def answer_policy(primary: Column, management: Column, status: Column, reason: Column) -> Column:
    """C-12: struct (policy_primary, strict_robustness, added_identified_management); contradictions are errors."""
    wrong = (primary & (~management | (status != "proposed_primary"))) | (management & ~primary & ((status != "sensitivity_only") | (reason != "identified_same_issuer_management_context"))) | (~management & ~status.isin("source_or_boundary_review", "exclude_procedural_or_empty"))
    fail = F.raise_error(F.lit("inconsistent source decision")).cast("boolean")
    return F.struct(F.when(wrong, fail).otherwise(management).alias("policy_primary"), primary.alias("strict_robustness"), (management & ~primary).alias("added_identified_management"))


def call_ledger(calls: DataFrame, pre: DataFrame, decisions: DataFrame, source: DataFrame) -> DataFrame:
    """A-15, C-11: each call's words by status, its blocks by lane, and the lanes that it is in.

    ``calls`` has event_id and speaker_gate_pass; ``source`` event_id, source_pre_words and source_qa_words.
    """
    words = lambda s: F.coalesce(F.sum(F.when(F.col("unit_status") == s, F.col("word_count"))), F.lit(0).cast("long")).alias(f"{s}_pre_words")
    of_pre = pre.groupBy("event_id").agg(words("proposed"), words("review"), words("procedural"), F.count_if(F.col("unit_status") == "proposed").alias("proposed_pre_units"))
    lane = lambda c: [F.count_if(F.col(f"{c}_block_candidate")).alias(f"{c}_qa_blocks"), F.coalesce(F.sum(F.when(F.col(f"{c}_block_candidate"), F.col("words"))), F.lit(0).cast("long")).alias(f"{c}_qa_words")]
    of_qa = decisions.groupBy("event_id").agg(F.count("*").alias("candidate_qa_blocks"), F.sum("words").alias("candidate_qa_words"), *lane("primary"), *lane("management_context"))
    joined = calls.join(source, "event_id", "left").join(of_pre, "event_id", "left").join(of_qa, "event_id", "left")
    counts = [c for df in (source, of_pre, of_qa) for c in df.columns if c != "event_id"]
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    gate, pre_ready = F.col("speaker_gate_pass"), F.col("proposed_pre_units") > 0
    primary = gate & pre_ready & (F.col("primary_qa_blocks") > 0)
    management = gate & pre_ready & (F.col("management_context_qa_blocks") > 0)
    covered = (F.col("primary_qa_blocks") >= 2) & (F.col("primary_qa_words") >= 100) & (F.col("primary_qa_words") >= F.lit(0.25) * F.col("source_qa_words"))
    reason = first_reason(
        (~gate, "speaker_gate_failed"), (~pre_ready, "no_source_screened_nonprocedural_pre_unit"), (primary, "proposed_primary_pair"), (management, "sensitivity_pair_only"),
        (F.col("candidate_qa_blocks") == 0, "no_extracted_ceo_qa_block"), default="no_primary_or_management_context_qa_block",
    )
    return joined.withColumns({
        "unassigned_ceo_qa_words": F.col("source_qa_words") - F.col("candidate_qa_words"),
        "ledger_reconciles": F.col("source_pre_words") == F.col("proposed_pre_words") + F.col("review_pre_words") + F.col("procedural_pre_words"),
        "primary_qa_word_coverage": F.try_divide(F.col("primary_qa_words"), F.col("source_qa_words")),
        "primary_call_candidate": primary, "management_context_call_candidate": management, "qa_coverage_call_candidate": primary & covered, "call_decision_reason": reason,
    })


def lane_support(calls: DataFrame, episodes: DataFrame, by: list[str], min_calls: int = 5, min_quarters: int = 5) -> DataFrame:
    """A-16: calls and quarters of each episode (with episode_analysis_gate_pass) in each lane, and whether they do."""
    aggregates = []
    for lane in LANES:
        on = F.col(f"{lane}_call_candidate")
        aggregates += [F.count_if(on).alias(f"{lane}_calls"), F.count_distinct(F.when(on, F.col("calendar_quarter"))).alias(f"{lane}_quarters")]
    counted = episodes.join(calls.groupBy(*by).agg(*aggregates), by, "left")
    counted = counted.withColumns({f"{lane}_{m}": F.coalesce(f"{lane}_{m}", F.lit(0).cast("long")) for lane in LANES for m in ("calls", "quarters")})
    gate = F.col("episode_analysis_gate_pass")
    meets = {lane: gate & (F.col(f"{lane}_calls") >= min_calls) & (F.col(f"{lane}_quarters") >= min_quarters) for lane in LANES}
    why = {f"{lane}_reason": first_reason((m, "meets_support"), (~gate, "speaker_episode_gate_failed"), default="insufficient_paired_calls_or_distinct_quarters") for lane, m in meets.items()}
    return counted.withColumns({f"{lane}_episode_candidate": m for lane, m in meets.items()} | why)


def lane_members(calls: DataFrame, turnovers: DataFrame, support: DataFrame, lane: str) -> DataFrame:
    """J-20: the lane's calls in episodes of turnovers whose gate passes and whose two episodes are candidates."""
    good = support.filter(F.col(f"{lane}_episode_candidate")).select(F.col("gvkey").alias("g"), F.col("execid").alias("x"), F.col("tenure_episode").alias("t"))
    pairs = turnovers.filter("turnover_analysis_gate_pass")
    for s in ("old", "new"):
        pairs = pairs.join(good, (F.col("gvkey") == F.col("g")) & (F.col(f"{s}_execid") == F.col("x")) & (F.col(f"{s}_tenure_episode") == F.col("t")), "left_semi")
    sides = pairs.select("gvkey", F.inline(F.array(*[F.struct(F.col(f"{s}_execid").alias("execid"), F.col(f"{s}_tenure_episode").alias("tenure_episode")) for s in ("old", "new")]))).distinct()
    return calls.filter(F.col(f"{lane}_call_candidate")).join(sides, ["gvkey", "execid", "tenure_episode"], "left_semi")


def call_coverage(calls: DataFrame, pre: DataFrame, qa: DataFrame) -> DataFrame:
    """A-17: units and words of each call (event_id, qa_ceo_word_count), the share that is scored, and both screens."""
    of_pre = pre.groupBy("event_id").agg(F.count("*").alias("pre_unit_count"), F.sum("unit_word_count").alias("pre_scored_word_count"))
    of_qa = qa.groupBy("event_id").agg(F.count("*").alias("high_qa_unit_count"), F.sum("unit_word_count").alias("high_qa_scored_word_count"))
    joined = calls.join(of_pre, "event_id", "left").join(of_qa, "event_id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("pre_unit_count", "pre_scored_word_count", "high_qa_unit_count", "high_qa_scored_word_count")})
    joined = joined.withColumn("high_qa_word_coverage", F.try_divide(F.col("high_qa_scored_word_count"), F.col("qa_ceo_word_count")))
    primary = (F.col("pre_unit_count") > 0) & (F.col("high_qa_unit_count") > 0)
    screen = (F.col("pre_unit_count") > 0) & (F.col("high_qa_unit_count") >= 2) & (F.col("high_qa_scored_word_count") >= 100) & F.coalesce(F.col("high_qa_word_coverage") >= 0.25, F.lit(False))
    return joined.withColumns({"primary_specificity_call_eligible": primary, "qa_quality_screen_call_eligible": screen})


def eligible_support(coverage: DataFrame, field: str, episode: str, turnovers: DataFrame, least: int = 5) -> DataFrame:
    """A-18: one row: episodes with ``least`` eligible calls, and turnovers (old_episode, new_episode) with two such."""
    good = coverage.filter(F.col(field)).groupBy(episode).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col(episode).alias("e"))
    both = turnovers.join(good, F.col("old_episode") == F.col("e"), "left_semi").join(good, F.col("new_episode") == F.col("e"), "left_semi")
    return good.agg(F.count("*").alias("episodes")).crossJoin(both.agg(F.count("*").alias("turnovers")))  # one row each


def turn_categories(turns: DataFrame, owned: DataFrame, audited: DataFrame) -> DataFrame:
    """J-21, C-17: executive turns (event_id, sequence_id, word_count, kind) as assigned_answer if a block owns them,
    else as audited (category), procedure_only, post_session_closing or unresolved."""
    joined = turns.join(owned.select("event_id", "sequence_id", "block_id"), ["event_id", "sequence_id"], "left").join(audited.select("event_id", "sequence_id", "category"), ["event_id", "sequence_id"], "left")
    category = F.when(F.col("block_id").isNotNull(), "assigned_answer").when(F.col("category").isNotNull(), F.col("category")).when(F.col("kind") == "closing_only", "post_session_closing").when(F.col("kind") != "", "procedure_only").otherwise("unresolved")
    return joined.select("event_id", "sequence_id", "word_count", category.alias("category"), "block_id")


def word_coverage(ledger: DataFrame, eligible: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """A-19: words of each event by category, and the ratios of eligible answers, null where the denominator is 0.

    Scored words stay null, which is not computed, until ``scores`` (block_id, score_status) exist.
    """
    marked = ledger.join(eligible.select("block_id", F.lit(True).alias("eligible")), "block_id", "left")
    if scores is not None:
        marked = marked.join(scores.select("block_id", "score_status"), "block_id", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("word_count"))), F.lit(0).cast("long"))
    of = lambda name: total(F.col("category") == name)
    valid = F.lit(None).cast("long") if scores is None else total(F.col("eligible") & (F.col("score_status") == "valid"))
    sums = marked.groupBy("event_id").agg(
        F.sum("word_count").alias("raw_ceo_qa_words"), of("assigned_answer").alias("assigned_answer_words"), of("procedure_only").alias("procedure_only_words"),
        of("post_session_closing").alias("post_session_closing_words"), of("unresolved").alias("unresolved_words"), total(F.col("eligible")).alias("eligible_answer_words"), valid.alias("validly_scored_words"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), b)
    return sums.withColumns({
        "raw_qa_word_share": ratio("eligible_answer_words", F.col("raw_ceo_qa_words")), "answer_inclusion_coverage": ratio("eligible_answer_words", F.col("assigned_answer_words")),
        "answer_inclusion_if_all_unresolved_are_answers": ratio("eligible_answer_words", F.col("assigned_answer_words") + F.col("unresolved_words")),
        "scoring_coverage": ratio("validly_scored_words", F.col("eligible_answer_words")),
    })
