"""Predicates on speaker labels: executives, analysts, operators (P-1 to P-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.text import affiliation, clean, has, label, left_of_dash, let, matches, norm, right_of_dash, word_count

# Patterns of speaker labels, titles and operators' announcements, matched without regard to case.
CEO = r"\b(?:ceo|chief\s+executive\s+officer)\b"
FORMER = r"\b(?:former|retired|ex[-\s])\b"
CEO_ASSISTANT = r"\b(?:ceo\s+assistant|assistant\s+to\s+(?:the\s+)?ceo)\b"
SPECIAL_CEO = r"\b(?:co[-\s]?(?:ceo|chief\s+executive(?:\s+officer)?)|(?:interim|acting)\s+(?:as\s+)?(?:the\s+)?(?:(?:president|chairman|chair|cfo|chief\s+financial\s+officer)\s*(?:and|&|/)\s*)*(?:(?:group|global)\s+)?(?:co[-\s]?)?(?:ceo|chief\s+executive(?:\s+officer)?))\b"
OPERATOR = r"\boperator\b"
NEXT_QUESTION = r"\b(?:our|the|next|first|follow[-\s]?up)\s+question\b|\bwe(?:'|’)ll\s+take\s+(?:our\s+)?next\s+question\b|\A(?:and\s+)?next[,\s]+we(?:['’]ll|\s+will)?\s+go\s+to\s+the\s+line\s+of\s+\S+"
OPERATOR_HANDOFF = r"(?:operator\s*:\s*)?(?:thank you\.?\s*)?(?:our|the|next|first)\s+question\s+comes\s+from"
ANALYST = r"\banalysts?\b"
ANALYST_LABEL = r"(?:Unidentified )?(?:(?:Senior|Junior) )?(?:(?:Equity )?Research )?Analysts?"
NOT_RESEARCH = r"\b(?:CEO|chief executive officer|CFO|chief financial officer|investor relations|corporate finance|former|retired)\b|\bex[- ](?:research )?analysts?\b|\banalysts? assistant\b|\bassistant to (?:the )?(?:research )?analysts?\b"
RESEARCH_LEAD = r"(?:MD|Managing Director|(?:Co[- ]?)?(?:Head|Director)) of (?:(?:[A-Za-z0-9&/]+[ -])+)?Research"
DIVISION_TITLE = r"MD|Managing Director|(?:(?:Senior|Junior) )?(?:Research )?Associate"


def ceo_signal(c: Column) -> Column:
    """P-1, P-2: chief executive, or ceo between characters that are no letters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("chief executive") | has(low, "(?:^|[^a-z])ceo(?:[^a-z]|$)")


def cfo_signal(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("chief financial") | has(low, "(?:^|[^a-z])cfo(?:[^a-z]|$)")


def analyst_signal(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains("analyst")


def operator_signal(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains("operator")


SIGNALS = {"ceo": ceo_signal, "cfo": cfo_signal, "analyst": analyst_signal, "operator": operator_signal}


def is_ceo(c: Column) -> Column:
    """P-3: a CEO token, and neither former nor a CEO's assistant."""
    text = label(c)
    return has(text, CEO, True) & ~has(text, FORMER, True) & ~has(text, CEO_ASSISTANT, True)


def is_special_ceo(c: Column) -> Column:
    """P-4: co-, interim or acting chief executives; an acting CFO alone is not one."""
    return has(c, SPECIAL_CEO, True)


def is_operator(c: Column) -> Column:
    return has(label(c), OPERATOR, True)


def is_next_question(name: Column, text: Column) -> Column:
    """P-6: an operator who hands over to the next questioner."""
    return is_operator(name) & has(clean(text), NEXT_QUESTION, True)


def is_analyst(c: Column, issuer_labels: Column | None = None) -> Column:
    """P-5: by the title after ' - '. Management and former analysts are none, nor speakers of an issuer's affiliation;
    analysts are; research leads and Research Division staff need a named institution. A label that is only a role
    must be an analyst's."""
    return let(label(c), lambda text: _is_analyst(text, issuer_labels))


def _is_analyst(text: Column, issuer_labels: Column | None) -> Column:
    identity, title = left_of_dash(text), right_of_dash(text)
    own = norm(affiliation(text))
    issuer = F.lit(False) if issuer_labels is None else (own != "") & F.exists(issuer_labels, lambda x: norm(affiliation(x)) == own)
    name, firm = F.split(identity, ",", 2)[0], F.coalesce(F.get(F.split(identity, ",", 2), F.lit(1)), F.lit(""))
    named = (F.trim(firm) != "") & (word_count(name) >= 2) & ~has(name, r"\b(?:unidentified|unknown|operator)\b", True) & ~has(firm, r"\b(?:unidentified|unknown)\b", True)
    division = has(firm, r"\bResearch Division\b", True)
    lead = matches(title, RESEARCH_LEAD, True)
    research = named & F.when(lead, division | has(title, r"\bEquity Research\z", True)).otherwise(division & matches(title, DIVISION_TITLE, True))
    return F.when(title.isNull(), matches(text, ANALYST_LABEL, True)).otherwise(~has(title, NOT_RESEARCH, True) & ~issuer & (has(title, ANALYST, True) | research))
