from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quillwork.functions import dates, names, procedure, roles, text


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("value", "cleaned", "words"), [(None, "", 0), ("", "", 0), ("  a b\n\tc ", "a b c", 3), ("   ", "", 0), ("one", "one", 1)])
def test_clean_and_words(spark, value, cleaned, words):
    assert one(spark, text.clean, value) == cleaned
    assert one(spark, text.word_count, value) == words


@pytest.mark.parametrize(("label", "key", "affiliation", "issuer"), [
    ("Jane  Roe, Acme Corp. - Chief Executive Officer [3]", "jane roe acme corp", "Acme Corp.", "Acme Corp."),
    ("John Doe, Jr., Big Bank, Research Division - Analyst", "john doe jr big bank research division", "Big Bank", "Research Division"),
    ("Operator", "operator", "", ""),
])
def test_labels(spark, label, key, affiliation, issuer):
    assert one(spark, text.speaker_key, label) == key
    assert one(spark, text.affiliation, label) == affiliation
    assert one(spark, lambda c: text.issuer_label(text.label(c)), label) == issuer


@pytest.mark.parametrize(("label", "ceo", "special", "analyst"), [
    ("A B, Acme - CEO", True, False, False), ("A B, Acme - Former CEO", False, False, False), ("A B, Acme - Assistant to the CEO", False, False, False),
    ("A B, Acme - Interim President & CEO", True, True, False), ("A B, Acme - Acting CFO", False, False, False), ("A B, Acme - Co-CEO", True, True, False),
    ("A B, Bank, Research Division - MD", False, False, True), ("A B, Bank - MD", False, False, False), ("A B, Bank - Head of Equity Research", False, False, True),
    ("A B, Bank - Senior Analyst", False, False, True), ("Unidentified Analyst", False, False, True), ("A B, Bank - Director of Investor Relations", False, False, False),
    ("A B, Bank - Former Analyst", False, False, False), ("A B, Big Bank, Research Division - Associate", False, False, True), ("Analyst, Big Bank, Research Division - Associate", False, False, False),
])
def test_roles(spark, label, ceo, special, analyst):
    assert one(spark, roles.is_ceo, label) is ceo
    assert one(spark, roles.is_special_ceo, label) is special
    assert one(spark, roles.is_analyst, label) is analyst


def test_issuer_staff_are_no_analysts(spark):
    issuer = F.array(F.lit("Jane Roe, Acme - CEO"))
    assert one(spark, lambda c: roles.is_analyst(c, issuer), "A B, ACME - Analyst") is False
    assert one(spark, lambda c: roles.is_analyst(c, issuer), "A B, Bank - Analyst") is True


@pytest.mark.parametrize(("said", "kind"), [
    ("Hi. Good morning, John.", "greeting_only"), ("Hi John. Can you hear me okay?", "audio_check"), ("Good morning. Revenue rose 5%.", ""), ("Sorry, could you repeat the question?", "clarification_request"),
    ("Could you repeat the question? We don't disclose that figure.", ""), ("Give Bob a second, he's looking it up.", "lookup_deferral"), ("Bob, do you want to take that?", "delegation_only"),
    ("Do you want to speak or do you want to join?", "logistics_question"), ("What's the call number and password?", "logistics_reply"), ("Um", "incomplete_fragment"),
    ("Thank you, operator. We will take your questions.", "question_invitation"), ("Thanks for joining us this morning.", "closing_only"), ("Thank you everyone for joining us. Margins will improve.", ""),
    ("", ""), (None, ""), ("I'll ask Bob to...", "delegation_only"), ("So if I understand your question, you want the margin, is that correct?", "clarification_request"),
])
def test_procedure_kinds(spark, said, kind):
    assert one(spark, procedure.procedure_kind, said) == kind


@pytest.mark.parametrize(("said", "is_ack"), [("Okay, thank you.", True), ("Okay?", False), ("Yes, go ahead", True), ("Yes, margins", False)])
def test_acknowledgements(spark, said, is_ack):
    assert one(spark, procedure.acknowledgement, said) is is_ack


def test_source_defects(spark):
    assert one(spark, procedure.source_defects, "We (inaudible) grew") == ["source_text_gap"]
    assert one(spark, procedure.source_defects, "We grew--") == ["trailing_source_fragment"]
    assert one(spark, procedure.source_defects, "We grew ...\n") == ["trailing_source_fragment"]
    assert one(spark, procedure.source_defects, "We grew.") == []


@pytest.mark.parametrize(("said", "asks"), [("Margins?", True), ("I was hoping for some color on pricing", True), ("Tell us more", True), ("Fine quarter", False), ("Can you hear me?", False)])
def test_question_candidates(spark, said, asks):
    assert one(spark, procedure.question_candidate, said) is asks


@pytest.mark.parametrize(("expected", "labelled", "relation"), [
    ("Jane Roe", "Jane Roe, Acme - CEO", "exact_full_name"), ("Jane Q. Roe", "Jane Roe", "same_first_last_middle_difference"), ("J. Robert Roe", "Robert Roe", "initial_prefix_plus_given_name"),
    ("J. Robert Roe", "Bob Roe", "initial_prefix_plus_recognized_nickname"), ("William Roe", "Bill Roe", "recognized_nickname_last_name"), ("Joe Taiclet", "Joseph Taicle", "recognized_transcription_variant"),
    ("Jane Roe", "Judy Roe", "same_initial_last_name_review"), ("Jane Roe", "Mary Roe", "same_last_name_different_first_name"), ("Jane Roe", "Jane Poe", "no_match"), ("Roe", "Jane Roe", "no_match"),
    ("Dr. Pat O'Neill Jr.", "Pat ONeill, Acme", "exact_full_name"),
])
def test_name_relations(spark, expected, labelled, relation):
    assert one(spark, lambda c: names.relation(c, F.lit(labelled)), expected) == relation


def test_best_match(spark):
    labels = F.array(F.lit("Mary Roe"), F.lit("Jane Roe, Acme"), F.lit("Jane Roe - CEO"))
    best = one(spark, lambda c: names.best_match(c, labels), "Jane Roe")
    assert (best.quality, best.labels) == ("exact_full_name", ["Jane Roe, Acme", "Jane Roe - CEO"])
    none = one(spark, lambda c: names.best_match(c, F.array().cast("array<string>")), "Jane Roe")
    assert (none.quality, none.labels) == ("no_match", [])


@pytest.mark.parametrize(("value", "day"), [("2000-01-31", (2000, 1, 31)), ("01/31/2000", (2000, 1, 31)), ("20000131", (2000, 1, 31)), ("31JAN2000", (2000, 1, 31)), ("31-Jan-2000", (2000, 1, 31)), ("2000-13-01", None), ("soon", None), ("", None), (None, None)])
def test_dates(spark, value, day):
    assert one(spark, dates.any_date, value) == (datetime.date(*day) if day else None)


def test_periods(spark):
    assert one(spark, lambda c: dates.period_bin(c, 2001), 2007, "int") == "2007-2012"
    with pytest.raises(Exception, match="outside all periods"):
        one(spark, lambda c: dates.period_bin(c, 2001), 1999, "int")


@pytest.mark.parametrize(("title", "company"), [
    ("Q3 2010 Acme Corp Earnings Conference Call", "Acme Corp"), ("Third Quarter 2010 Acme Earnings Call (Webcast)", "Acme"), ("Full Year 2011 Acme &amp; Co Results Briefing", "Acme & Co"),
    ("Acme's Fiscal Year 2009 Results", "Acme"), ("Acme - Strategy day", "Acme"), (None, ""),
])
def test_titles(spark, title, company):
    assert one(spark, text.title_company, title) == company


def test_ratio_and_sets(spark):
    assert one(spark, lambda c: text.ratio_text(c, F.lit(16)), 1, "int") == "0.062"
    assert one(spark, lambda c: text.ratio_text(c, F.lit(0)), 1, "int") == ""
    assert one(spark, lambda c: text.set_text(F.split(c, ",")), "b,a,,b") == "a;b"
    assert one(spark, text.cusip8, "03-783310 0") == "03783310"
    assert one(spark, text.cusip8, "0378") == ""
