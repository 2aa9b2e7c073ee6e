from __future__ import annotations

import itertools
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions import ranges, stats
from quillwork.operators import census, contracts, coverage, diagnostics, gate, sampling, scoring, tenure, turnover, units
from quillwork.plans import measures, samples


def test_waterfall_counts_and_limits(spark):
    rows = [(5, "F", 2010), (2, "F", 1999), (3, "X", 2005), (4, "F", 2004), (1, "F", 2005)]
    df = spark.createDataFrame(rows, "event_id long, type string, year int")
    out = census.waterfall(df, [("filter", F.col("event_id") == 4), ("type", F.col("type") != "F"), ("year", F.col("year") < 2001)], limit=1)
    assert {r.step: r.rows for r in out.collect()} == {"input": 5, "filter": 1, "type": 1, "year": 1, "eligible": 2, "over_limit": 1}


def test_measured_zero(spark):
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    turns = spark.createDataFrame([(1, "PRE"), (1, None), (1, "Q&A"), (1, "odd")], "event_id long, section string")
    got = {r.event_id: r for r in census.census(events, turns).collect()}
    assert (got[1].total_rows, got[1].other_rows, got[1].kinds) == (4, 2, "PRE;Q&A;OTHER")
    assert (got[2].total_rows, got[2].kinds, got[2].no_text) == (0, "", True)


@pytest.mark.parametrize(("rows", "status"), [
    ([(2000, "2000-01-01", "12/31/2001"), (2001, "01/01/2000", "2001-12-31")], "exact_tenure_dates"),
    ([(2000, "2000-01-01", "2001-12-31"), (2001, "2000-02-01", "2001-12-31")], "source_boundary_conflict_review"),
    ([(2000, "someday", "2001-12-31"), (2001, "", "")], "source_boundary_conflict_review"),
    ([(2000, "", ""), (2001, None, None)], "annual_flag_date_bounds"),
    ([(2000, "2001-05-01", "2000-05-01")], "invalid_date_order_review"),
])
def test_tenure_boundaries(spark, rows, status):
    df = spark.createDataFrame([("001", 7, *r) for r in rows] + [("001", 7, None, "", "")], "gvkey string, execid int, year int, becameceo string, leftofc string")
    got = tenure.episodes(df).collect()
    assert [r.normalization_status for r in got] == [status]


def test_returning_person_and_next_start(spark):
    rows = [("001", 7, 2000, "2000-01-01", ""), ("001", 8, 2001, "2001-03-01", "2003-12-31"), ("001", 7, 2005, "2005-01-01", "2005-06-30")]
    got = {(r.execid, r.tenure_episode): r for r in tenure.episodes(spark.createDataFrame(rows, "gvkey string, execid int, year int, becameceo string, leftofc string")).collect()}
    assert got[7, 1].end_date == date(2001, 3, 1) and got[7, 1].end_date_source == tenure.END_NEXT
    assert {r.normalization_status for r in got.values()} == {"exact_tenure_dates"} and len(got) == 3


def test_coverage_keeps_ambiguity(spark):
    day = date(2005, 1, 1)
    tenures = [("A", "g1", 1), ("A", "g2", 2), ("B", "g3", 3), ("B", "g3", 4), ("C", "g4", 5), ("D", "", 6)]
    t = spark.createDataFrame([(k, g, x, 1, date(2004, 1, 1), date(2006, 1, 1) if x != 2 else date(2004, 6, 1), tenure.EXACT) for k, g, x in tenures], "key string, gvkey string, execid long, tenure_episode int, start_date date, end_date date, normalization_status string")
    calls = spark.createDataFrame([(1, day, "A"), (2, day, "B"), (3, day, "C"), (4, day, ""), (5, day, "Z"), (6, day, "D")], "event_id long, event_date date, key string")
    got = coverage.cover(calls, t)
    assert {r.event_id: r.ceo_coverage_status for r in got.collect()} == {
        1: "review_ambiguous_issuer_match", 2: "review_multiple_ceos_cover_event", 3: "covered_exact_ceo_tenure", 4: "not_testable_no_issuer_match", 5: "not_testable_no_issuer_match", 6: "review_ambiguous_issuer_match",
    }
    assert [r.event_id for r in coverage.exact_panel(got).collect()] == [3]


@pytest.fixture()
def two_tenures(spark):
    days = [date(2001, 1, 15) + timedelta(days=90 * k) for k in range(10)]
    change = days[4] + timedelta(days=1)
    schema = "gvkey string, execid long, tenure_episode int, start_date date, end_date date, normalization_status string"
    tenures = [("1", 10, 1, date(2001, 1, 1), change, tenure.EXACT), ("1", 11, 1, change, date(2004, 1, 1), tenure.EXACT)]
    panel = [(*tenures[k > 4], 100 + k, d) for k, d in enumerate(days)]
    return spark.createDataFrame(tenures, schema), spark.createDataFrame(panel, schema + ", event_id long, event_date date")


def test_turnover_is_ready(two_tenures):
    rows = turnover.turnovers(*two_tenures).collect()
    assert [(r.turnover_id, r.anchor_turnover_ready, r.call_gap_days, r.old_last_event_id, r.new_first_event_id) for r in rows] == [("execucomp_turnover_00001", True, 90, 104, 105)]
    assert turnover.panel_violations(two_tenures[1], two_tenures[0]).count() == 0


def test_panel_violations(two_tenures):
    tenures, panel = two_tenures
    moved = panel.withColumn("start_date", F.date_sub("start_date", 1))
    assert {r.violations for r in turnover.panel_violations(moved, tenures).collect()} == {"boundary_changed"}
    again = panel.unionByName(panel.limit(1))
    assert "duplicate_call" in turnover.panel_violations(again, tenures).first().violations
    late = panel.withColumn("event_date", F.date_add("event_date", 4000))
    assert turnover.panel_violations(late, tenures).first().violations == "date_outside_tenure"


def test_rotation_shifts_when_a_stratum_ends():
    assert turnover.rotation({"a": 1, "b": 3, "c": 2}, 10) == [("a", 1), ("c", 1), ("b", 1), ("c", 2), ("b", 2), ("b", 3)]


LABEL = "Jane Roe, Acme - CEO"


@pytest.mark.parametrize(("turns", "name", "identity", "external"), [
    ([("PRE", LABEL), ("Q&A", LABEL)], "Jane Roe", "exact_single_shared_speaker_key", "confirmed_external_ceo_shared_pre_qa"),
    ([("PRE", LABEL), ("Q&A", "Ann Poe, Acme - CEO")], "Jane Roe", "review_or_no_shared_speaker_key", "review_external_ceo_present_one_section"),
    ([("PRE", "Jane Roe, Acme - Interim CEO"), ("Q&A", "Jane Roe, Acme - Interim CEO")], "Jane Roe", "review_special_ceo_title", "review_external_ceo_present_both_sections_not_strict_shared"),
    ([("PRE", LABEL), ("Q&A", LABEL)], "J. Roe", "exact_single_shared_speaker_key", "review_external_ceo_initial_last_name"),
    ([("PRE", LABEL), ("PRE", "Ann Poe, Acme - CEO"), ("Q&A", LABEL)], "Jane Roe", "review_side_multiple_ceo_candidates", "review_external_ceo_present_both_sections_not_strict_shared"),
    ([("PRE", LABEL), ("Q&A", LABEL), ("Q&A", "Ann Poe, Acme - CEO")], "Jane Roe", "exact_single_shared_speaker_key", "confirmed_external_ceo_shared_pre_qa"),
    ([], "Jane Roe", "review_or_no_shared_speaker_key", "not_confirmed_external_ceo_not_title_labelled"),
])
def test_identity(spark, turns, name, identity, external):
    rows = spark.createDataFrame([(1, s, n) for s, n in turns], "event_id long, section string, text_name string")
    expected = spark.createDataFrame([(1, name)], "event_id long, expected_ceo_name string")
    got = gate.identity(gate.candidate_evidence(rows), expected).first()
    assert (got.within_call_identity_status, got.external_speaker_validation_status) == (identity, external)
    assert got.event_speaker_gate_pass == external.startswith("confirmed")


def test_labels_of_a_key_are_all_kept(spark):
    rows = [(1, "PRE", LABEL), (1, "PRE", "Jane Roe, Acme - Chairman"), (1, "PRE", "Bob Moe, Acme - CFO")]
    got = gate.candidate_evidence(spark.createDataFrame(rows, "event_id long, section string, text_name string")).collect()
    assert [(r.speaker_key, r.labels) for r in got] == [("jane roe acme", [LABEL, "Jane Roe, Acme - Chairman"])]


def test_aliases(spark):
    rows = [(1, "Zeta", "t"), (1, "Alpha", "t"), (2, "A", "t"), (3, "A", "t"), (3, "B", "u"), (4, "A", "t"), (4, "A", "t"), (5, "A", "t"), (5, " ", "t")]
    got = {r.k: (r.kept_name, r.status) for r in contracts.resolve_aliases(spark.createDataFrame(rows, "k int, name string, text string"), ["k"], "name", ["text"]).collect()}
    assert got[1] == ("Alpha", "exact_alias") and got[2] == ("A", "unique")
    assert {got[3][1], got[4][1], got[5][1]} == {"error_payload_differs", "error_not_two_aliases"}
    with pytest.raises(contracts.ContractError):
        a = spark.createDataFrame([(1,)], "k int")
        contracts.merge_sources(a, a, keys=["k"])


def test_fetch_audit_violations(spark):
    rows = [(1, "ok", "", 2), (2, "ok", "x", 2), (3, "review", "duplicate_sequence_id", 2), (4, "review", "other", 2), (5, "odd", "", 2), (6, "ok", "", -1), (7, "ok", None, 1), (7, "ok", None, 1)]
    got = contracts.fetch_audit_violations(spark.createDataFrame(rows, "event_id long, fetch_status string, fetch_notes string, fetched_rows long"))
    assert sorted((r.event_id, r.violation) for r in got.collect()) == [(2, "ok_with_notes"), (4, "unknown_review_reason"), (5, "unknown_status"), (6, "bad_row_count"), (7, "repeated_event")]


def brute_chunks(text, most=150, least=50):
    import re

    text = " ".join(text.split())
    if len(text.split()) <= most:
        return [text] if text else []
    pieces = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        w = s.split()
        pieces += [" ".join(w[k : k + most]) for k in range(0, len(w), most)]
    out = [[]]
    for p in pieces:
        if out[-1] and sum(len(x.split()) for x in out[-1]) + len(p.split()) > most:
            out.append([])
        out[-1].append(p)
    chunks = [" ".join(c) for c in out]
    if len(chunks) > 1 and len(chunks[-1].split()) < least:
        chunks[-2:] = [" ".join(chunks[-2:])]
    return chunks


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["", "a b.", " x " * 151, "w " * 300 + ". " + "v " * 10] + [" ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", "", ".", "?"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.c for r in df.select("k", units.chunks(F.col("t")).alias("c")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute_chunks(t)


def test_word_coverage_is_null_until_scored(spark):
    ledger = spark.createDataFrame([(1, 1, 60, "assigned_answer", "b1"), (1, 2, 20, "unresolved", None), (1, 3, 20, "procedure_only", None), (2, 1, 10, "unresolved", None)], "event_id long, sequence_id long, word_count long, category string, block_id string")
    eligible = spark.createDataFrame([("b1",)], "block_id string")
    got = {r.event_id: r for r in units.word_coverage(ledger, eligible).collect()}
    assert (got[1].raw_qa_word_share, got[1].answer_inclusion_coverage, got[1].answer_inclusion_if_all_unresolved_are_answers) == (0.6, 1.0, 0.75)
    assert got[1].scoring_coverage is None and got[1].validly_scored_words is None and got[2].answer_inclusion_coverage is None
    scores = spark.createDataFrame([("b1", "valid")], "block_id string, score_status string")
    assert {r.event_id: r.scoring_coverage for r in units.word_coverage(ledger, eligible, scores).collect()} == {1: 1.0, 2: None}


def test_kappa_and_ranks(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for power, quadratic in ((1, False), (2, True)):
        weight = np.abs(np.subtract.outer(np.arange(5), np.arange(5)) / 4) ** power
        table = np.zeros((5, 5))
        for a, b in pairs:
            table[a - 1, b - 1] += 1
        expected = 1 - (weight * table).sum() / (weight * np.outer(table.sum(1), table.sum(0)) / len(pairs)).sum()
        assert stats.weighted_kappa(df, "a", "b", quadratic).first().kappa == pytest.approx(expected)
    same = spark.createDataFrame([(3, 3)] * 4, "a int, b int")
    assert stats.weighted_kappa(same, "a", "b", True).first().kappa is None
    assert stats.spearman(same, "a", "b").first().spearman is None
    ranks = stats.rank_table(spark.createDataFrame([(5,), (1,), (5,), (9,)], "v int"), "v", "r").collect()
    assert sorted((r.v, r.r) for r in ranks) == [(1, 1.0), (5, 2.5), (5, 2.5), (9, 4.0)]


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "s string, available long")
    assert {r.s: r.target for r in sampling.allocate(counts, "s", 8, 2, 3).collect()} == {"a": 2, "b": 3, "c": 3}
    with pytest.raises(ValueError, match="below the minimum"):
        sampling.allocate(counts, "s", 5, 2, 3)
    with pytest.raises(Exception, match="too few rows"):
        sampling.allocate(counts, "s", 18, 6, 3).collect()


def test_capped_selection():
    rows = [{"event_id": k, "stratum": "ab"[k % 2], "exec": k % 4, "company": k % 3} for k in range(40)]
    got = sampling.capped_selection(rows, {"a": 3, "b": 2}, 1, "lane", {"exec": 2, "company": 2})
    assert [r["stratum"] for r in got] == ["a"] * 3 + ["b"] * 2
    for c in ("exec", "company"):
        assert max([r[c] for r in got].count(v) for v in {r[c] for r in got}) <= 2
    with pytest.raises(ValueError, match="missing"):
        sampling.capped_selection(rows, {"a": 9}, 1, "lane", {"exec": 2})


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_select_capped_walks_the_whole_table(spark, batch):
    """The same rows in the same order as the walk over all rows, where caps skip many; nulls are a value."""
    rows = [{"event_id": k, "stratum": "aab"[k % 3], "exec": None if k % 7 == 0 else k % 5, "company": k % 4 or None} for k in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "event_id long, stratum string, exec long, company long")
    caps = {"exec": 2, "company": 3}
    assert sampling.select_capped(df, {"b": 4, "a": 5}, 1, "lane", caps, batch) == sampling.capped_selection(rows, {"b": 4, "a": 5}, 1, "lane", caps)
    with pytest.raises(ValueError, match="missing for a"):
        sampling.select_capped(df, {"b": 4, "a": 9}, 1, "lane", caps, batch)


def test_capped_selection_query_reads_all_orders(spark, tmp_path):
    """A stratum whose rows are rare among 6,000 orders is still filled, as the walk over all of them says."""
    rows = [{"event_id": k, "stratum": "P" if k % 1200 == 0 else "FO"[k % 2], "exec": k % 997, "company": k % 997 % 50} for k in range(6000)]
    orders = spark.createDataFrame([(r["event_id"], r["stratum"], r["exec"]) for r in rows], "o_orderkey long, o_orderstatus string, o_custkey long")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    expected = sampling.capped_selection(rows, {"F": 8, "O": 8, "P": 4}, samples.SEED, "calls", {"exec": 2, "company": 3})
    assert [r.asDict() for r in samples.capped_selection(spark, str(tmp_path)).collect()] == expected


@pytest.mark.parametrize("n", [0, 1, 3, 7, 12, 40])
def test_spread_sample(spark, n):
    rng = random.Random(n)
    rows = [(e, e * 100 + k) for e in range(7) for k in range(rng.randrange(1, 5))]
    got = sorted((r.sample_rank, r.id) for r in sampling.spread_sample(spark.createDataFrame(rows, "e int, id int").repartition(3), "e", "id", n).collect())
    first, rest = [e * 100 for e in range(7)], [i for _, i in rows if i % 100]
    expected = [first[k] for k in sampling.spread_indexes(7, n)] if n <= 7 else first + [rest[k] for k in sampling.spread_indexes(len(rest), min(n - 7, len(rest)))]
    assert [i for _, i in got] == expected


def test_strict_json(spark):
    texts = ['{"ok":1,"specificity":3}', '{"ok":1,"ok":1}', '{"ok":NaN}', '{"ok":1} x', '{"ok":1e999}', "", None, '{"specificity":0, "ok":0}', '{"ok":true,"specificity":1}', '{"ok":1,"specificity":6}', '{"ok":0,"specificity":2}', '{"ok":1,"specificity":2,"x":1}', "[1]", '{"ok":1.0,"specificity":2}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", scoring.strict_json(F.col("t")))
    got = {r.k: (r.p, r.e) for r in df.select("k", "p", scoring.score_error(F.col("p")).alias("e")).collect()}
    assert [k for k, (p, _) in got.items() if p is None] == [1, 2, 3, 4, 5, 6]
    assert [k for k, (_, e) in got.items() if e == ""] == [0, 7]


def test_label_states(spark):
    rows = [("substantive", "1", "3", ""), ("procedural_only", "0", "0", ""), ("uncertain", "", "", "garbled")]
    df = spark.createDataFrame(rows, "c string, o string, s string, n string")
    state = scoring.label_state(*[F.col(x) for x in "cosn"])
    assert [(r.x.state, r.x.ok, r.x.score) for r in df.select(state.alias("x")).collect()] == [("scored", 1, 3), ("procedural_only", 0, None), ("source_uninterpretable", None, None)]
    for bad in (("uncertain", "", "", ""), ("procedural_only", "1", "3", ""), ("odd", "1", "3", ""), ("mixed", "1", "6", ""), ("mixed", "0", "0", "")):
        with pytest.raises(Exception, match="inconsistent or unfinished"):
            spark.createDataFrame([bad], df.schema).select(state).collect()


def test_attempts(spark):
    rows = [("a", 1, True, False, None, None), ("b", 1, False, True, None, "error"), ("b", 2, True, False, "error", None), ("c", 1, True, False, None, None), ("c", 2, True, False, "error", None),
            ("d", 1, False, True, None, "error"), ("d", 2, False, True, "error", "error"), ("d", 3, True, False, "error", None), ("e", 1, False, True, None, "error"), ("e", 2, True, False, "other", None)]
    got = {r.custom_id: (r.final_valid, r.violation) for r in scoring.reconcile_attempts(spark.createDataFrame(rows, "custom_id string, attempt int, valid boolean, retryable boolean, retry_reason string, reason string"), ["attempt"]).collect()}
    assert got == {"a": (True, ""), "b": (True, ""), "c": (True, "retry_without_technical_failure"), "d": (True, "third_attempt"), "e": (True, "retry_reason_differs")}


def test_scorer_errors_stay_in_rows(spark):
    def fails(texts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("1", "x"), ("2", None), ("3", "y" * 50)], "id string, t string")
    got = {r.custom_id: (r.status, r.raw_output) for r in scoring.score_requests(rows, scoring.stub_scorer, "id", "t", max_chars=40).collect()}
    assert got == {"1": ("completed", '{"ok": 1, "specificity": 2}'), "2": ("completed", '{"ok": 0, "specificity": 0}'), "3": ("rejected", None)}
    assert {r.status for r in scoring.score_requests(rows, fails, "id", "t").collect()} == {"error"}


RESULT = {
    "status": "completed", "validation_error": None, "output_truncated": False, "finish_reason": "eos_token", "input_truncated": False, "input_context_rejected": False, "generated_token_ids": [5, 6, 2],
    "terminal_eos_token_id": 2, "configured_eos_token_ids": [2], "tokenizer_special_token_ids": [1, 2], "raw_output": '{"ok":1,"specificity":3}', "terminal_eos_text": "</s>", "raw_output_with_special_tokens": '{"ok":1,"specificity":3}</s>', "stored": '{"ok":1,"specificity":3}',
}


@pytest.mark.parametrize(("change", "error"), [
    ({}, ""), ({"status": "error"}, "output status is not completed"), ({"output_truncated": True}, "missing or invalid EOS termination evidence"), ({"input_truncated": None}, "input truncation/rejection evidence missing or invalid"),
    ({"generated_token_ids": [5, 1, 2]}, "invalid generated-token/EOS evidence"), ({"generated_token_ids": []}, "invalid generated-token/EOS evidence"), ({"terminal_eos_text": ""}, "full decoded response differs from payload plus terminal EOS"),
    ({"raw_output": "no", "raw_output_with_special_tokens": "no</s>"}, "not strict JSON"), ({"stored": '{"ok":1,"specificity":4}'}, "stored parsed output differs from strict whole-raw parse"),
])
def test_result_validity(spark, change, error):
    schema = "status string, validation_error string, output_truncated boolean, finish_reason string, input_truncated boolean, input_context_rejected boolean, generated_token_ids array<long>, terminal_eos_token_id long, configured_eos_token_ids array<long>, tokenizer_special_token_ids array<long>, raw_output string, terminal_eos_text string, raw_output_with_special_tokens string, stored string"
    row = RESULT | change
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema).withColumn("p", scoring.strict_json(F.col("raw_output")))
    assert df.select(scoring.result_error(F.col("p"), scoring.strict_json(F.col("stored"))).alias("e")).first().e == error


def brute_matches(pre, qa, caliper):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j):
        if i == len(pre) or j == len(qa):
            return (0, 0)
        options = [best(i + 1, j), best(i, j + 1)]
        if (gap := abs(pre[i][0] - qa[j][0])) <= caliper:
            n, d = best(i + 1, j + 1)
            options.append((n + 1, d - gap))
        return max(options)

    return best(0, 0)


def test_matching_is_optimal():
    rng = random.Random(3)
    for _ in range(40):
        pre, qa = (sorted((rng.randrange(60), str(k)) for k in range(rng.randrange(12))) for _ in range(2))
        pairs = diagnostics.match_ordered(pre, qa, 6)
        gaps = [abs(pre[i][0] - qa[j][0]) for i, j in pairs]
        assert (len(pairs), -sum(gaps)) == brute_matches(tuple(pre), tuple(qa), 6)
        assert all(g <= 6 for g in gaps) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def table_matches(pre, qa, caliper):
    """The reference's table of best (pairs, distance) over all units, and its order of choice: skip, skip, match."""
    best = [[(0, 0)] * (len(qa) + 1) for _ in range(len(pre) + 1)]
    moves = {}
    for i, j in itertools.product(range(1, len(pre) + 1), range(1, len(qa) + 1)):
        gap = abs(pre[i - 1][0] - qa[j - 1][0])
        n, d = best[i - 1][j - 1]
        options = [best[i - 1][j], best[i][j - 1], (n + 1, d - gap) if gap <= caliper else (-1, 0)]
        best[i][j], moves[i, j] = max(options), options.index(max(options))
    pairs, i, j = [], len(pre), len(qa)
    while i and j:
        move = moves[i, j]
        if move == 2:
            pairs.append((i - 1, j - 1))
        i, j = i - (move != 1), j - (move != 0)
    return pairs[::-1]


def test_matching_chooses_as_the_reference():
    """Of matchings that are equally good, the same one, where few and where many units share a length."""
    rng = random.Random(5)
    for _ in range(400):
        span, caliper = rng.choice([1, 4, 12, 40]), rng.choice([0, 1, 3, 15])
        pre, qa = (sorted((rng.randrange(span) if rng.random() < 0.5 else rng.randrange(span) ** 2 // span, f"{k:02}") for k in range(rng.randrange(30))) for _ in range(2))
        assert diagnostics.match_ordered(pre, qa, caliper) == table_matches(pre, qa, caliper), (pre, qa, caliper)


def test_matching_grows_with_lengths_not_units():
    """A table of 300,000 by 300,000 units would take 90 GB."""
    units = [(k // 1000, "") for k in range(300_000)]
    assert diagnostics.match_ordered(units, units, 15) == [(k, k) for k in range(300_000)]
    assert diagnostics.match_counts([(2 * k, 10**9) for k in range(50)], [(2 * k + 1, 10**9) for k in range(50)], 15) == [(k, 0, k, 0, 10**9) for k in range(50)]


def test_length_matches_are_those_of_the_table(spark):
    """Many units of one length, in several ranges of the id; nulls and other sections."""
    rng = random.Random(8)
    rows = [(f"p{k % 2}", rng.choice(["PRE", "PRE", "Q&A"]), f"u{rng.randrange(10**6)}x{k}", rng.choice([7, 7, 7, 8, 11, 30, 52, 53]), rng.choice([None, 1.0, 2.0, 3.5])) for k in range(400)]
    odd = [("p0", "PRE", None, 7, 9.0), ("p0", "Q&A", "u1", None, 1.0), (None, "PRE", "u2", 7, 1.0), ("p0", "other", "u3", 7, 1.0), ("p3", "PRE", "u4", 7, 1.0)]
    df = spark.createDataFrame(rows + odd, "period_bin string, section string, unit_id string, words long, score double").repartition(5)
    expected = []
    for p in ("p0", "p1"):
        of = lambda section: sorted((r for r in rows + odd if r[:2] == (p, section) and r[3] is not None), key=lambda r: (r[3], r[2] is None, r[2]))  # noqa: E731, B023
        pre, qa = of("PRE"), of("Q&A")
        for i, j in table_matches([r[3:4] for r in pre], [r[3:4] for r in qa], 5):
            (_, _, a, v, s), (_, _, b, w, t) = pre[i], qa[j]
            expected.append((p, a, b, v, w, abs(v - w), None if s is None or t is None else t - s))
    got = diagnostics.length_matches(df, 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert diagnostics.length_matches(df.filter("section = 'PRE'"), 5).count() == 0 == diagnostics.length_matches(df.limit(0), 5).count()


def test_regression_and_bootstrap(spark):
    rng = np.random.default_rng(1)
    n = 300
    words = rng.integers(20, 400, n)
    qa = rng.integers(0, 2, n)
    score = 2 + 0.5 * qa + 0.3 * np.log(words / 140) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([("p1" if k % 2 else "p2", "Q&A" if q else "PRE", str(k), int(w), float(s)) for k, (w, q, s) in enumerate(zip(words, qa, score))], "period_bin string, section string, unit_id string, words long, score double")
    got = {r.term: r for r in diagnostics.length_regression(df).collect()}
    assert abs(got["qa_indicator"].estimate - 0.5) < 0.05 and got["qa_indicator"].normal_approx_p < 1e-6
    assert abs(got["log_words_centered"].estimate - 0.3) < 0.05
    assert diagnostics.length_regression(df.filter("section = 'PRE'")).count() == 0
    ci = diagnostics.bootstrap(df.withColumn("side", F.when(F.col("section") == "PRE", "pre").otherwise("qa")), "score", "side", draws=500)
    a, b = ci.first(), ci.first()
    assert a == b and a.low < a.estimate < a.high and a.draws == 500
    assert diagnostics.bootstrap(df.limit(0), "score").first().estimate is None


def test_bootstrap_query_draws_as_often_as_the_reference(spark, sf_dir):
    ci = measures.bootstrap_ci(spark, sf_dir).first()
    assert ci.draws == 10_000 and ci.low < ci.estimate < ci.high


def test_sequence_ids():
    assert scoring.sequence_ids('["12", 7, "007"]') == ["12", "7", "007"] and scoring.sequence_ids("[]") == []
    for bad in (None, "", "[1", "{}", '"12"', "[1.5]", "[-1]", "[true]", "[null]", '["a"]', '["1", 1]', "[[1]]"):
        with pytest.raises(ValueError, match="sequence"):
            scoring.sequence_ids(bad)


def test_require_schema():
    expected = {"type": "object", "properties": {"score": {"type": "integer", "minimum": 0}}}
    scoring.require_schema({"title": "t", "$schema": "s", "description": "d", "properties": {"score": {"minimum": 0, "type": "integer"}}, "type": "object"}, expected)
    for bad in (None, [], {}, {**expected, "required": ["score"]}, {**expected, "properties": {"score": {"type": "integer", "minimum": 0, "title": "t"}}}, {**expected, "properties": {"score": {"type": "integer", "minimum": 0.0}}}):
        with pytest.raises(ValueError, match="response schema"):
            scoring.require_schema(bad, expected)


def test_regression_equals_dense_hc3(spark):
    rng = np.random.default_rng(2)
    n = 120
    words, qa, period = rng.integers(20, 400, n), rng.integers(0, 2, n), rng.integers(0, 3, n)
    score = rng.integers(1, 6, n).astype(float)
    df = spark.createDataFrame([(f"p{p}", "Q&A" if q else "PRE", str(k), int(w), float(s)) for k, (w, q, p, s) in enumerate(zip(words, qa, period, score))], "period_bin string, section string, unit_id string, words long, score double")
    size = np.log(words / 140)
    x = np.column_stack([np.ones(n), qa, size, size**2, qa * size, period == 1, period == 2]).astype(float)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ score
    scaled = x * ((score - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inverse, x)))[:, None]
    errors = np.sqrt(np.diag(inverse @ scaled.T @ scaled @ inverse))
    got = diagnostics.length_regression(df, interaction=True).collect()
    assert np.allclose([r.estimate for r in got], beta) and np.allclose([r.hc3_standard_error for r in got], errors) and got[0].n == n


def test_matching_in_pieces_is_as_good_as_whole(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(2)}", rng.choice(["PRE", "Q&A"]), f"{k:03}", rng.randrange(600), float(k % 5)) for k in range(150)]
    got = diagnostics.length_matches(spark.createDataFrame(rows, "period_bin string, section string, unit_id string, words long, score double"), 6).collect()
    for p in ("p0", "p1"):
        pre, qa = (sorted((w, u) for q, s, u, w, _ in rows if (q, s) == (p, side)) for side in ("PRE", "Q&A"))
        pairs = diagnostics.match_ordered(pre, qa, 6)
        mine = [r.absolute_word_difference for r in got if r.period_bin == p]
        assert (len(mine), sum(mine)) == (len(pairs), sum(abs(pre[i][0] - qa[j][0]) for i, j in pairs))


def test_sums_before(spark):
    rng = random.Random(6)
    rows = [(f"k{k:04}", rng.randrange(9)) for k in range(500)]
    got = ranges.sums_before(spark.createDataFrame(rows, "k string, n int").repartition(7), "k", before=F.col("n"), place=F.lit(1)).collect()
    total = 0
    for place, r in enumerate(sorted(got)):
        assert (r.before, r.place) == (total, place)
        total += r.n
    assert ranges.sums_before(spark.createDataFrame([], "k string, n int"), "k", before=F.col("n")).count() == 0
