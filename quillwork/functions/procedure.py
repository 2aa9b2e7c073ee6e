"""Whole-passage procedure, source defects and question candidates (T-12 to T-18, C-9). No model: unknown text stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.text import clean, first_reason, has, let, matches, norm, reasons, sentences, word_count


def _any(*phrases: str) -> str:
    return "(?:" + "|".join(phrases) + ")"


_THANKS = _any("thanks", "thank you")
_HELLO = _any("hi", "hello", "hey", "good morning", "good afternoon")

# Phrases of whole-passage procedure, as normalised text (lower case, single spaces, no punctuation).
ACKNOWLEDGEMENTS = ["yes", "yeah", "yep", "okay", "ok", "correct", "exactly", "right", "sure", "thanks", "thank you", "i can", "we can", "i can hear you", "we can hear you", "that is right", "that s right", "that is correct", "that s correct", "please go ahead", "go ahead"]
GREETING_ANSWERS = ["yes", "yeah", "sure", "good", "thanks", "thank you", "we re fine", "we re doing good", "how are you"]
FRAGMENTS = ["well", "uh", "um"]
AUDIO_CUES = ["can you hear (?:us|me)(?: (?:okay|ok|now))?", "are you (?:there|on the line)", "let me (?:do a quick check|check)"]
AUDIO_INTROS = ["(?:yes|hi|hello)(?: [a-z]+){0,2}", "this is(?: [a-z]+){1,3}"]
CLARIFICATIONS = [
    "(?:could|can|would) you (?:please )?(?:repeat|clarify)(?: (?:the|your) question| (?:that|it))?(?: again)?(?: please)?",
    "(?:could|can|would) you (?:please )?say (?:that|it) again(?: please)?",
    "i (?:missed|did not hear|didn t hear|did not catch|didn t catch) (?:your|the|that) question",
    "(?:i )?i (?:m|am) not sure i (?:understand|follow) (?:your|the) question",
]
COURTESIES = ["(?:i m|i am) sorry", "sorry", "well", "please", "thanks", "thank you"]
LOOKUP = ["give [a-z]+ a second (?:he s|she s|they re) looking (?:that|it) up"]
DELEGATIONS = [
    "[a-z]+ do you have (?:a good estimate|an estimate|a number|the number)",
    "[a-z]+ (?:(?:can|could|would) you (?:please )?|(?:do )?you want to )take (?:it|that|this)",
    "i(?: ve got| have) to turn to [a-z]+ for that one",
]
OPEN_DELEGATION = "i (?:am going to|m going to|will|ll) ask [a-z]+(?: [a-z]+)? to"
LOGISTICS_QUESTIONS = ["do you want to (?:speak|attend|join)(?: or do you want to (?:speak|attend|join))?(?: it)?"]
LOGISTICS_REPLIES = ["(?:give me|what is|what s) the (?:conference )?call number(?: and (?:the )?password)?"]
INVITATIONS = ["(?:now )?(?:we would be happy to take|we will take|we are ready for) (?:any |your )?questions(?: you may have)?"]
CLOSINGS = [
    "(?:well )?thanks for joining us this morning",
    "if you have any further questions please don t hesitate to call our investor relations team(?: and thanks for your support)?",
    "(?:well )?i d like to thank (?:everyone|everybody) for (?:their|your) attention today",
    "(?:feel )?please feel free to reach out to our (?:ir|investor relations) team with any questions(?: and have a great day)?",
    "(?:and )?have a great day(?: and thank you for your time)?",
    "thanks for your time today",
    "(?:thank you (?:all|everyone|everybody)|thanks everyone) for joining (?:us|the call)",
    "(?:thanks|thank you)(?: everyone| all| [a-z]+)?(?: for joining us)?",
    "all right(?: [a-z]+)?",
    "we (?:certainly )?(?:again )?appreciate (?:everyone s|everybody s|your) (?:interest|support)(?: and i m certain we re going to field follow up questions later)?",
    "thanks for (?:your )?(?:interest|support)",
    "we appreciate you being with us today(?: and your continued interest in (?:[a-z]+ ){0,3}[a-z]+)?",
    "we look forward to reporting further advances in [a-z]+ and the opportunity to talk to you again",
    "have a (?:great|good|nice) day",
    "we will see you soon",
    "we know it s a busy day out there in the market",
    "and i m certain we re going to field follow up questions later",
]

# Cues of questions, as normalised text.
QUESTION_CUES = ["what", "when", "where", "why", "how", "could", "can you", "would you", "do you", "talk about", "tell us", "give us", "help me", "help us", "wondering", "curious", "walk us", "explain", "quantify"]
DETAIL_REQUEST = (
    r"\b(?:i|we) (?:am|are|was|were|would be) (?:just |also )?(?:looking|hoping) for (?:just )?(?:kind of )?"
    r"(?:a little bit |a little |a bit |an? |some )?(?:more |additional |further )?"
    r"(?:details?|colou?r|clarification|update|breakdown|explanation) (?:on|about|regarding|around|of) \S"
)
NEW_QUESTION = r"\b(?:next|another|separate|second|follow up) (?:question|topic)|\bjust as a follow up\b"
PROCEDURAL_KINDS = ["greeting_only", "audio_check", "lookup_deferral", "delegation_only", "clarification_request", "logistics_question", "logistics_reply", "question_invitation", "closing_only"]


def acknowledgement(c: Column) -> Column:
    """T-12: nothing but words of assent or thanks, and no question mark."""
    return ~has(c, r"\?") & matches(norm(c), rf"(?:{_any(*ACKNOWLEDGEMENTS)}\s*)+")


def _every(pieces: Column, must: Column, may) -> Column:
    return (F.size(pieces) > 0) & must & F.forall(pieces, may)


def audio_check(c: Column) -> Column:
    """T-13: every sentence is a line check or an introduction, and one is a check."""
    return _audio(sentences(c))


def _audio(pieces: Column) -> Column:
    cue = lambda p: matches(p, _any(*AUDIO_CUES))
    return _every(pieces, F.exists(pieces, cue), lambda p: cue(p) | matches(p, _any(*AUDIO_INTROS)))


def clarification_only(c: Column) -> Column:
    """T-14: every sentence, after an apology, asks for clarification or is courtesy, and one asks."""
    return _clarification(sentences(c))


def _clarification(pieces: Column) -> Column:
    cue = lambda p: matches(F.regexp_replace(p, r"\A(?:well )?(?:(?:i m|i am) sorry |sorry )?", ""), _any(*CLARIFICATIONS))
    return _every(pieces, F.exists(pieces, cue), lambda p: cue(p) | matches(p, _any(*COURTESIES)))


def procedure_kind(c: Column) -> Column:
    """T-15: the first kind of procedure that the whole passage is, else ''."""
    return let(F.struct(norm(c).alias("n"), sentences(c).alias("p"), F.coalesce(c, F.lit("")).alias("c")), lambda t: _kind(t["n"], t["p"], t["c"]))


def _kind(n: Column, pieces: Column, c: Column) -> Column:
    whole = lambda phrases: matches(n, _any(*phrases))
    greeting = has(n, rf"\b{_HELLO}\b") & matches(n, rf"(?:{_any(*GREETING_ANSWERS)}\s*|{_HELLO}(?: [a-z]+)?\s*)+")
    understood = (word_count(n) <= 60) & has(n, r"\A(?:so )?if i understand your question\b") & ~has(c, r"[.!?]\s+\S") & has(n, r"\b(?:do i have that right|is that correct)\z")
    invited = lambda p: matches(p, _any(*INVITATIONS))
    return first_reason(
        (greeting, "greeting_only"),
        (_audio(pieces), "audio_check"),
        (whole(LOOKUP), "lookup_deferral"),
        (whole(DELEGATIONS) | (matches(n, OPEN_DELEGATION) & has(c, r"(?:\.{3}|…)\s*\z")), "delegation_only"),
        (_clarification(pieces) | understood, "clarification_request"),
        (whole(LOGISTICS_QUESTIONS), "logistics_question"),
        (whole(LOGISTICS_REPLIES), "logistics_reply"),
        (n.isin(*FRAGMENTS), "incomplete_fragment"),
        (_every(pieces, F.exists(pieces, invited), lambda p: invited(p) | matches(p, rf"{_THANKS}(?: [a-z]+){{0,2}}")), "question_invitation"),
        (_every(pieces, F.lit(True), lambda p: matches(p, _any(*CLOSINGS))), "closing_only"),
        default="",
    )


def source_defects(c: Column) -> Column:
    """T-16: bracketed gaps and trailing fragments."""
    gap = has(c, r"\([^)]*\b(?:inaudible|indiscernible|multiple speakers|technical difficulties)\b[^)]*\)", True)
    return reasons((gap, "source_text_gap"), (has(c, r"(?:\.{3}|…|--|—)\s*[.!?]?\s*\z"), "trailing_source_fragment"))


def question_candidate(c: Column) -> Column:
    """T-17: not procedure, and a question mark, a question cue or a sentence that asks for detail."""
    asks = has(c, r"\?") | has(norm(c), rf"\b{_any(*QUESTION_CUES)}\b") | F.exists(sentences(c), lambda p: has(p, DETAIL_REQUEST))
    return (procedure_kind(c) == "") & asks


def announces_new_question(c: Column) -> Column:
    return has(norm(c), NEW_QUESTION)


def answer_flags(c: Column) -> Column:
    """T-18: reasons that a whole answer has no substance."""
    kind = procedure_kind(clean(c))
    return reasons(
        (kind == "clarification_request", "CEO_ANSWER_IS_CLARIFICATION_REQUEST"),
        (kind == "closing_only", "CEO_ANSWER_IS_CLOSING_REMARKS"),
        ((word_count(c) < 25) & has(clean(c), r"(?:--|—)\s*\z"), "CEO_ANSWER_IS_INCOMPLETE_FRAGMENT"),
    )


def answer_exclusions(c: Column) -> Column:
    """T-18, E-7: why an answer is no scoring unit; empty if it is one."""
    text = clean(c)
    kind = procedure_kind(text)
    found = F.concat(source_defects(text), F.when(kind != "", F.array(F.concat(F.lit("procedural_"), kind))).otherwise(F.array().cast("array<string>")), reasons(((word_count(text) < 25) & has(text, r"(?:--|—)\s*\z"), "incomplete_fragment")))
    return F.when(text == "", F.array(F.lit("empty_ceo_answer"))).otherwise(found)


def question_exclusions(c: Column) -> Column:
    found = F.transform(source_defects(c), lambda r: F.concat(F.lit("question_"), r))
    return F.when(clean(c) == "", F.array(F.lit("empty_analyst_question"))).otherwise(found)


def content_decision(c: Column) -> Column:
    """C-9: struct (content_class, content_reason, ready). Unclassified content is kept."""

    def decide(kind: Column, empty: Column) -> Column:
        out = empty | kind.isin(*PROCEDURAL_KINDS)
        reason = F.when(empty, F.lit("empty_target")).when(out, F.concat(F.lit("exact_procedural_pattern_"), kind)).otherwise("nonprocedural_text_retained_without_semantic_classification")
        return F.struct(F.when(out, "procedural_only").otherwise("uncertain").alias("content_class"), reason.alias("content_reason"), (~out).alias("ready"))

    return let(F.struct(procedure_kind(c).alias("kind"), (clean(c) == "").alias("empty")), lambda t: decide(t["kind"], t["empty"]))
