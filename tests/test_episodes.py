from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillwork.operators import episodes, gate, units

CEO, CFO, A, B, OP = "Jane Roe, Acme - CEO", "Tom Moe, Acme - Chief Financial Officer", "Ann Lee, Big Bank - Analyst", "Bob Fox, Old Fund LLC - Analyst", "Operator"
INTERIM = "Jane Roe, Acme - Interim CEO"
ASK = "Could you explain the margin outlook for the next fiscal year in detail?"
SAY = "We expect margins to expand steadily as volume grows across every region that we serve."
OPENING = ((CEO, "Welcome to the call. We had a fine quarter in all regions."),)


def around(*middle):
    return [(A, ASK), (CEO, SAY), *middle, (CEO, SAY)]


# The Q&A turns (numbered from 100) and the presentation of each event.
EVENTS = {
    "two questions": ([(A, ASK), (CEO, SAY), (OP, "Our next question comes from Bob Fox."), (B, ASK), (CEO, SAY)], OPENING),
    "another analyst": (around((B, ASK)), OPENING),
    "a new question": (around((A, "One separate question. " + ASK)), OPENING),
    "an operator before": (around((OP, "Please hold."), (A, ASK)), OPENING),
    "thanks": (around((A, "Okay, thank you.")), OPENING),
    "bare name and firm": (around((OP, "Bob Fox, Old Fund."), (B, ASK)), OPENING),
    "bare name of firm": (around((OP, "Bob Fox of Old Fund"), (B, ASK)), OPENING),
    "bare name of another firm": (around((OP, "Bob Fox, Older Fund."), (B, ASK)), OPENING),
    "closing": (around((OP, "This concludes the question and answer session.")), OPENING),
    "management": (around((CFO, SAY)), OPENING),
    "restatement": ([(A, ASK), (CEO, "Sorry, could you repeat the question?"), (A, "The margin outlook, what is it for next year?"), (CEO, SAY)], OPENING),
    "interruption": ([(A, ASK), (CEO, SAY + " And --"), (A, "Can you --"), (CEO, SAY)], OPENING),
    "counter question": ([(A, ASK), (CEO, "You mean the gross margin for the group, or for the segment?"), (A, "The gross margin of the whole group, what would that be?"), (CEO, SAY)], OPENING),
    "counter question, then an operator": ([(A, ASK), (CEO, "You mean the gross margin for the group, or for the segment?"), (A, ASK), (CFO, SAY), (OP, "Our next question, please."), (A, ASK), (CEO, SAY)], OPENING),
    "logistics": ([(A, ASK), (CEO, "Do you want to join?"), (A, "What is the call number?"), (CEO, SAY)], OPENING),
    "no anchor": ([(A, ASK), (CEO, SAY)], ((CFO, "Hello."),)),
    "short": ([(A, "Margins?"), (CEO, "They are fine.")], OPENING),
    "interim": ([(A, ASK), (INTERIM, SAY)], ((INTERIM, SAY),)),
    "decisions": ([(A, ASK), (CEO, SAY), (CFO, SAY), (B, ASK), (CEO, "Thanks for joining us this morning."), (OP, "Our next question please."), (A, ASK), (CEO, SAY)], OPENING),
    "no answer": ([(CEO, SAY), (A, ASK), (B, ASK)], OPENING),
}
NUMBER = {name: k for k, name in enumerate(EVENTS)}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(NUMBER[e], k + base, s, n, t) for e, (qa, pre) in EVENTS.items() for s, base, turns in (("PRE", 0, pre), ("Q&A", 100, qa)) for k, (n, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "event_id long, sequence_id int, section string, text_name string, text_contents string").repartition(3)
    expected = turns.select("event_id").distinct().withColumn("expected_ceo_name", F.lit("Jane Roe"))
    calls = gate.identity(gate.candidate_evidence(turns), expected)
    anchors = calls.select("event_id", "shared_keys", "shared_labels", F.filter(F.split("identity_flags", ";"), lambda f: f != "").alias("flags")).cache()
    return turns, anchors, episodes.blocks(turns, anchors).cache()


@pytest.fixture(scope="module")
def by_event(found):
    out = {name: [] for name in EVENTS}
    names = list(EVENTS)
    for r in found[2].orderBy("event_id", "block_no").collect():
        out[names[r.event_id]].append(r)
    return out


@pytest.mark.parametrize(("event", "expected", "flags"), [
    ("two questions", [([100], [101]), ([103], [104])], []),
    ("another analyst", [([100], [101]), ([102], [103])], []),
    ("a new question", [([100], [101]), ([102], [103])], []),
    ("an operator before", [([100], [101, 102]), ([103], [104])], ["OPERATOR_INTERRUPTION_REVIEW"]),
    ("thanks", [([100], [101, 102, 103])], ["ANALYST_ACKNOWLEDGEMENT_RETAINED_IN_CONTEXT"]),
    ("bare name and firm", [([100], [101]), ([103], [104])], []),
    ("bare name of firm", [([100], [101]), ([103], [104])], []),
    ("bare name of another firm", [([100], [101, 102]), ([103], [104])], ["OPERATOR_INTERRUPTION_REVIEW"]),
    ("closing", [([100], [101])], ["OPERATOR_CLOSING_BOUNDARY"]),
    ("management", [([100], [101, 102, 103])], ["NON_CEO_MANAGEMENT_CONTEXT"]),
    ("restatement", [([100, 102], [101, 102, 103])], ["QUESTION_RESTATEMENT_LINK_REVIEW"]),
    ("no anchor", [], []),
    ("no answer", [], []),
    ("short", [([100], [101])], ["SHORT_ANALYST_QUESTION", "SHORT_CEO_ANSWER"]),
    ("interim", [([100], [101])], ["SPECIAL_CEO_TITLE"]),
])
def test_boundaries(by_event, event, expected, flags):
    rows = by_event[event]
    assert [(r.question_sequence_ids, r.context_sequence_ids) for r in rows] == expected
    assert not rows or rows[0].block_flags == flags


@pytest.mark.parametrize(("event", "tier"), [("two questions", "high"), ("thanks", "high"), ("closing", "high"), ("management", "usable_with_flag"), ("restatement", "review"), ("short", "high"), ("interim", "usable_with_flag")])
def test_tiers(by_event, event, tier):
    assert by_event[event][0].quality_tier == tier


def test_procedural_turns_leave_the_answer(by_event):
    r = by_event["restatement"][0]
    assert (r.ceo_answer_sequence_ids, r.procedural_sequence_ids) == ([103], [101])
    r = by_event["logistics"][0]
    assert (r.question_sequence_ids, r.ceo_answer_sequence_ids, r.procedural_sequence_ids) == ([100], [103], [101, 102])
    assert "LOGISTICS_INTERRUPTION_LINK_REVIEW" in r.block_flags


def test_interrupted_answer(by_event):
    rows = by_event["interruption"]
    assert [r.question_sequence_ids for r in rows] == [[100]] and "INTERRUPTED_CONTINUATION_LINK_REVIEW" in rows[0].block_flags


def test_counter_question_carries_over(by_event):
    rows = by_event["counter question"]
    assert [r.question_sequence_ids for r in rows] == [[100], [102]]
    assert "UNRESOLVED_CEO_COUNTERQUESTION_REVIEW" in rows[0].block_flags
    assert "PRECEDING_QUESTION_CONTEXT_REVIEW" in rows[1].block_flags and rows[1].preceding_question_context == ASK


def test_operator_between_ends_the_carry(by_event):
    rows = by_event["counter question, then an operator"]
    assert [r.question_sequence_ids for r in rows] == [[100], [105]]
    assert "UNRESOLVED_CEO_COUNTERQUESTION_REVIEW" in rows[0].block_flags and rows[1].preceding_question_context == ""


def test_event_statuses(found):
    _, anchors, blocks = found
    got = {r.event_id: r.event_audit_status for r in episodes.event_audit(anchors, blocks).collect()}
    assert got[NUMBER["no anchor"]] == "exclude_no_same_ceo"
    assert got[NUMBER["no answer"]] == "review_no_ceo_answer_to_analyst_question"
    assert got[NUMBER["thanks"]] == "usable"


def test_blocks_agree_with_turns(found):
    turns, _, blocks = found
    assert episodes.block_violations(blocks, turns).count() == 0 and episodes.shared_answer_turns(blocks).count() == 0
    broken = blocks.withColumn("ceo_answer", F.concat("ceo_answer", F.lit("!")))
    assert {r.violations for r in episodes.block_violations(broken, turns).collect()} == {"answer_differs"}


def test_decisions(found):
    turns, anchors, blocks = found
    of = blocks.filter(F.col("event_id") == NUMBER["decisions"])
    got = {r.block_id.rsplit("_", 1)[1]: (r.inclusion_status, r.inclusion_reason) for r in units.classify_blocks(of, units.management_context(of, turns, anchors)).collect()}
    assert got == {
        "100": ("sensitivity_only", "identified_same_issuer_management_context"), "103": ("exclude_procedural_or_empty", "empty_target"),
        "106": ("proposed_primary", "high_tier_source_screen_pass"),
    }


def test_given_roles(spark):
    """E-3: questioners and unresolved speakers from elsewhere."""
    rows = [(1, 1, "Q&A", "Guest One", ASK, True, False), (1, 2, "Q&A", CEO, SAY, False, False), (1, 3, "Q&A", "Someone", "Hm.", False, True), (1, 4, "Q&A", CEO, SAY, False, False)]
    turns = spark.createDataFrame(rows, "event_id long, sequence_id int, section string, text_name string, text_contents string, is_questioner boolean, is_unresolved boolean")
    got = episodes.segment(episodes.facts(turns)).collect()
    assert {(r.part, r.sequence_id, r.flag) for r in got} == {("questions", 1, None), ("context", 2, None), ("flag", None, "UNRESOLVED_SPEAKER_BOUNDARY_REVIEW"), ("operator_before", None, None)}
