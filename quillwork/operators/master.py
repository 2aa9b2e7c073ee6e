"""Event master: section, firm-match and manager ladders (C-1 to C-3, T-22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.text import first_reason, reasons


def section_ladder(pre_rows: Column, qa_rows: Column, total_rows: Column) -> Column:
    """C-1: struct (section_status, difference_status, export_status, repair_probe, repair_priority)."""
    row = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("section_status", "difference_status", "export_status", "repair_probe", "repair_priority"), strict=True)])
    pre, qa = pre_rows > 0, qa_rows > 0
    probe = lambda priority: row("raw_pre_only", "needs_hidden_qna_repair_probe", "candidate_after_repair_if_qna_found", 1, priority)
    return (
        F.when(pre & qa, row("raw_both_pre_and_qa", "candidate_raw_sections", "candidate_text_export", 0, "none"))
        .when(pre & (pre_rows >= 3), probe("high"))
        .when(pre, probe("medium"))
        .when(qa, row("raw_qa_only", "exclude_no_presentation", "text_only_no_difference", 0, "none"))
        .when(total_rows == 0, row("raw_no_text", "exclude_no_text", "exclude_no_text", 0, "none"))
        .otherwise(row("other_or_unusual_text_type", "review_section_type", "review_before_text_export", 1, "medium"))
    )


def identifiers(present: dict[str, Column]) -> Column:
    """T-22: the names of the identifiers that are not blank, in the given order."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", n) for n, c in present.items()]))


# Identifier levels, the strongest first.
SECURITY = ["isin", "cusip", "sedol"]
EXTERNAL = ["ric", "ticker"]
INTERNAL = ["company_id"]


# The key recommended at each level, and status and risk by (name conflict, level).
MATCH_KEYS = {
    "security": "security_identifier_plus_event_date", "ric": "company_ric_plus_event_date", "ticker": "ticker_plus_event_date_plus_historical_name_review",
    "internal": "ccts_company_id_bridge_required", "manual": "manual_name_date_review_required",
}
FIRM_STATUS = {
    (True, "security"): ("review_title_name_conflict_identifier_backed", "medium"),
    (True, "external"): ("review_title_name_conflict_external_id_limited", "medium_high"),
    (True, "internal"): ("high_risk_title_name_conflict_internal_id_only", "high"),
    (True, "none"): ("high_risk_title_name_conflict_no_identifier", "high"),
    (False, "security"): ("ok_identifier_backed", "low"),
    (False, "external"): ("ok_external_id_limited", "medium_low"),
    (False, "internal"): ("review_internal_id_only", "medium_high"),
    (False, "none"): ("review_missing_identifier", "high"),
}


def firm_ladder(present: Column, company_tokens: Column, title_tokens: Column) -> Column:
    """C-2, O-6: struct (match_key, name_conflict, status, risk, reasons) from the identifiers present.

    A conflict is a company with words none of which the event's title has.
    """
    any_of = lambda names: F.arrays_overlap(present, F.array(*[F.lit(n) for n in names]))
    conflict = (F.size(company_tokens) > 0) & (F.size(F.array_intersect(company_tokens, title_tokens)) == 0)
    levels = [(any_of(SECURITY), "security"), (any_of(EXTERNAL), "external"), (any_of(INTERNAL), "internal")]
    key = first_reason((any_of(SECURITY), MATCH_KEYS["security"]), (any_of(["ric"]), MATCH_KEYS["ric"]), (any_of(["ticker"]), MATCH_KEYS["ticker"]), (any_of(INTERNAL), MATCH_KEYS["internal"]), default=MATCH_KEYS["manual"])
    ladder = lambda k: F.when(conflict, first_reason(*[(c, FIRM_STATUS[True, n][k]) for c, n in levels], default=FIRM_STATUS[True, "none"][k])).otherwise(first_reason(*[(c, FIRM_STATUS[False, n][k]) for c, n in levels], default=FIRM_STATUS[False, "none"][k]))
    why = reasons((conflict, "company_tokens_not_in_event_title"), (~any_of(SECURITY), "no_isin_cusip_sedol"), (~any_of(EXTERNAL), "no_external_identifier"))
    return F.struct(key.alias("match_key"), conflict.alias("name_conflict"), ladder(0).alias("status"), ladder(1).alias("risk"), F.array_join(why, ";").alias("reasons"))


def manager_layer(ceo_rows: Column, participant_rows: Column) -> Column:
    """C-3: what the manager layer can be built from; a null count of CEO rows was not computed."""
    return first_reason(
        (ceo_rows > 0, "participant_ceo_signal_available"),
        (ceo_rows.isNull() & (participant_rows > 0), "participant_rows_only_role_signals_not_computed"),
        (participant_rows > 0, "participants_available_no_ceo_signal"),
        default="no_participant_rows",
    )
