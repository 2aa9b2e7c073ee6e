"""Question-and-answer episodes of calls: the cursor over ordered turns, block assembly and checks (E-1 to E-5, C-13, C-14)."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import procedure, roles
from quillwork.functions.text import first_reason, has, join_turns, label, left_of_dash, matches, norm, reasons, speaker_key, word_count

# Patterns of an operator's closing, of legal forms at the end of a firm, and of a bare "Name, Firm".
_CLOSING = r"\b(?:no further questions|any (?:additional )?closing remarks|any closure or further remarks|any closing or further remarks|(?:that|this) (?:will )?(?:conclude|concludes) the (?:q\s*&\s*a|question(?:s)? and answer(?:s)?) session)\b"
_LEGAL_FORM = r"\s+(?:and company|company|inc|llc|ltd|corp|corporation)\z"
_NAME_AND_FIRM = r"\A([A-Z][a-zA-Z'-]+(?: [A-Z][a-zA-Z'.-]+){1,3}), ([A-Za-z][A-Za-z &.'-]{1,65})\.?\z"

# First words of an announcement that are no name.
_NO_NAME = ["please", "thank", "operator", "our", "next"]

# Flags that keep a block out of the high tier.
EXCLUSION_FLAGS = [
    "QUESTION_CONTAINS_OPERATOR_HANDOFF", "NO_SUBSTANTIVE_CEO_TURN", "CEO_ANSWER_IS_CLARIFICATION_REQUEST", "SPECIAL_CEO_TITLE", "MULTIPLE_SHARED_CEO_CANDIDATES",
    "MULTIPLE_CEOS_IN_ANSWER_CONTEXT", "CEO_ANSWER_IS_CLOSING_REMARKS", "CEO_ANSWER_IS_NONSUBSTANTIVE_PLEASANTRY", "CEO_ANSWER_IS_INCOMPLETE_FRAGMENT",
]


def facts(turns: DataFrame, issuer_labels: Column | None = None) -> DataFrame:
    """All that the cursor asks of a turn, as columns; text stays behind.

    ``turns`` has event_id, sequence_id, section, text_name, text_contents, and may have is_questioner and
    is_unresolved (E-3: roles known from elsewhere), else questioners are analysts by label and none is unresolved.
    """
    name, text = F.col("text_name"), F.coalesce("text_contents", F.lit(""))
    tag = label(name)
    identity_parts = F.split(left_of_dash(tag), ",", 2)
    firm = F.regexp_replace(norm(F.get(identity_parts, F.lit(1))), _LEGAL_FORM, "")
    person = norm(identity_parts[0])
    nameable = (F.size(identity_parts) > 1) & (F.size(F.split(person, " ")) >= 2) & ~person.contains("unidentified") & (firm != "")
    said = F.trim(text)
    announced = F.when(said.rlike(_NAME_AND_FIRM) & ~F.split(norm(F.regexp_extract(said, _NAME_AND_FIRM, 1)), " ")[0].isin(*_NO_NAME), norm(F.regexp_extract(said, _NAME_AND_FIRM, 2)))
    given = set(turns.columns)
    return turns.select(
        "event_id", F.col("sequence_id").cast("long").alias("sequence_id"), speaker_key(name).alias("speaker"),
        (F.col("is_questioner") if "is_questioner" in given else roles.is_analyst(name, issuer_labels)).alias("asks"),
        (F.col("is_unresolved") if "is_unresolved" in given else F.lit(False)).alias("unresolved"),
        roles.is_operator(name).alias("operator"), roles.is_next_question(name, text).alias("hands_over"), has(text, _CLOSING, True).alias("closes"),
        procedure.procedure_kind(text).alias("kind"), procedure.acknowledgement(text).alias("acknowledges"), procedure.announces_new_question(text).alias("new_question"),
        has(text, r"(?:--|—)\s*\z").alias("breaks_off"), matches(said, r"(?:do you have any|can you|could you)\s*(?:--|—)", True).alias("fragment"),
        (has(text, r"\?\s*\z") & (F.size(F.split(said, r"\s+")) <= 40)).alias("counters"), norm(text).alias("said"), announced.alias("announced_firm"),
        F.when(nameable, F.array(F.concat_ws(" ", person, firm), F.concat(person, F.lit(" of "), firm))).alias("own_announcements"),
        F.when(F.size(identity_parts) > 1, norm(F.get(identity_parts, F.lit(1)))).alias("own_firm"),
        (F.lower(tag) == "unidentified company representative").alias("anonymous"),
        matches(norm(text), "(?:he|she) should be on the operator just needs to open (?:his|her) line").alias("asks_line"),
        matches(norm(text), "operator (?:can|could) you please open [a-z]+(?: [a-z]+){0,3} s line").alias("confirms_line"),
    )


@dataclass
class Episode:
    questions: list[dict]
    context: list[dict]
    procedural: list[dict]
    flags: set[str]
    end: int


class Cursor:
    """One event's turns in order. A rule looks at a turn and returns None, or what to do: stop, or keep it as parts."""

    def __init__(self, turns: list[dict]) -> None:
        self.turns = turns

    def at(self, k: int) -> dict | None:
        return self.turns[k] if 0 <= k < len(self.turns) else None

    def episode(self, start: int) -> Episode:
        e = Episode([self.turns[start]], [], [], set(), start + 1)
        who = self.turns[start]["speaker"]
        while (t := self.at(e.end)) and t["asks"] and t["speaker"] == who:
            e.questions.append(t)
            e.end += 1
        while t := self.at(e.end):
            parts, flag = self.decide(e, t, who)
            if flag:
                e.flags.add(flag)
            if not parts:
                break
            for part in parts:
                getattr(e, part).append(t)
            e.end += 1
        return e

    def decide(self, e: Episode, t: dict, who: str) -> tuple[tuple[str, ...], str]:
        """(the parts that the turn joins, a flag); no part: the episode ends before it."""
        if t["unresolved"]:
            return self.unresolved(e, t)
        if t["operator"]:
            return self.operator(e, t)
        if not t["asks"]:
            return ("context",), ""
        answer = next((x for x in reversed(e.context) if not x["asks"] and not x["operator"]), None)
        if t["speaker"] != who or answer is None or any(x["operator"] for x in e.context) or t["new_question"]:
            return (), ""
        following = self.at(e.end + 1)
        goes_on = following and not following["asks"] and not following["operator"] and following["speaker"] == answer["speaker"]
        if answer["breaks_off"] and t["fragment"] and goes_on:
            return ("context",), "INTERRUPTED_CONTINUATION_LINK_REVIEW"
        if t["acknowledges"]:
            return ("procedural", "context"), "ANALYST_ACKNOWLEDGEMENT_RETAINED_IN_CONTEXT"
        if answer["kind"] in ("audio_check", "clarification_request"):
            return ("questions", "context"), "QUESTION_RESTATEMENT_LINK_REVIEW"
        if answer["kind"] == "logistics_question" and t["kind"] == "logistics_reply":
            return ("procedural", "context"), "LOGISTICS_INTERRUPTION_LINK_REVIEW"
        return (), "UNRESOLVED_CEO_COUNTERQUESTION_REVIEW" if answer["counters"] else ""

    def unresolved(self, e: Episode, t: dict) -> tuple[tuple[str, ...], str]:
        following = self.at(e.end + 1)
        known = following and not (following["unresolved"] or following["asks"] or following["operator"])
        if e.context and known and t["anonymous"] and t["asks_line"] and following["confirms_line"]:
            return ("context", "procedural"), "UNIDENTIFIED_COMPANY_LOGISTICS_LINK_REVIEW"
        return (), "UNRESOLVED_SPEAKER_BOUNDARY_REVIEW"

    def operator(self, e: Episode, t: dict) -> tuple[tuple[str, ...], str]:
        if t["closes"]:
            return (), "OPERATOR_CLOSING_BOUNDARY"
        following = self.at(e.end + 1)
        named = following and following["asks"] and t["said"] in (following["own_announcements"] or ())
        if t["hands_over"] or self.announces(e.end, t) or named:
            return (), ""
        return ("context",), "OPERATOR_INTERRUPTION_REVIEW"

    def announces(self, k: int, t: dict) -> bool:
        """Whether a bare "Name, Firm" precedes a questioner of that firm, with at most a greeting between."""
        firm, following = t["announced_firm"], self.at(k + 1)
        if following and not following["asks"] and not following["operator"]:
            following = self.at(k + 2) if following["kind"] == "greeting_only" else None
        if not firm or len(firm) < 3 or not following or not following["asks"] or following["own_firm"] is None:
            return False
        return (following["own_firm"] + " ").startswith(firm + " ")


_FACTS = ["speaker", "asks", "operator", "kind"]


def segment(known: DataFrame) -> DataFrame:
    """E-1: a row for each turn of each episode, from ``facts``: event_id, block_no, part (questions, context or
    procedural), sequence_id and what is known of the turn. A flag is a row too, and so is the last operator's turn
    before the episode (operator_before).

    An event's Q&A turns are walked in their order in one task: each step depends on the one before. Their texts don't
    come along.
    """
    schema = "event_id long, block_no int, part string, sequence_id long, flag string, speaker string, asks boolean, operator boolean, kind string"
    kinds = [("event_id", pa.int64()), ("block_no", pa.int32()), ("part", pa.string()), ("sequence_id", pa.int64()), ("flag", pa.string()), ("speaker", pa.string()), ("asks", pa.bool_()), ("operator", pa.bool_()), ("kind", pa.string())]

    def walk(table: pa.Table) -> pa.Table:
        turns = table.sort_by("sequence_id").to_pylist()
        cursor, out, k, number, operator = Cursor(turns), [], 0, 0, None
        while k < len(turns):
            if not turns[k]["asks"]:
                operator = turns[k]["sequence_id"] if turns[k]["operator"] else operator
                k += 1
                continue
            e = cursor.episode(k)
            number += 1
            base = dict.fromkeys(n for n, _ in kinds) | {"event_id": turns[0]["event_id"], "block_no": number}
            out += [base | {"part": part, "sequence_id": t["sequence_id"]} | {f: t[f] for f in _FACTS} for part in ("questions", "context", "procedural") for t in getattr(e, part)]
            out += [base | {"part": "flag", "flag": f} for f in sorted(e.flags)]
            out.append(base | {"part": "operator_before", "sequence_id": operator})
            operator = max([x["sequence_id"] for x in turns[k : e.end] if x["operator"]], default=operator)
            k = e.end
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return known.groupBy("event_id").applyInArrow(walk, schema)


def blocks(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """E-2, C-13: the blocks of calls with an answer by an anchor.

    ``anchors`` has event_id, shared_keys (speaker keys that are CEO in both sections), shared_labels and flags of the
    event. A block has the question, the anchors' turns that are not whole procedure as answer, and all turns of the
    answer as context, each with ids and text.
    """
    qa = turns.filter(F.col("section") == "Q&A").join(anchors.select("event_id", F.col("shared_labels").alias("__issuer")), "event_id", "left")
    cut = segment(facts(qa, F.coalesce("__issuer", F.array().cast("array<string>"))))
    said = turns.select(F.col("event_id").alias("__e"), F.col("sequence_id").cast("long").alias("__s"), label(F.col("text_name")).alias("label"), F.coalesce("text_contents", F.lit("")).alias("text"))
    parts = cut.join(said, (F.col("event_id") == F.col("__e")) & (F.col("sequence_id") == F.col("__s")), "left").join(anchors, "event_id", "left")
    ceo = F.coalesce(F.array_contains("shared_keys", F.col("speaker")), F.lit(False))
    turn = F.struct("sequence_id", "speaker", "label", "text", "asks", "operator", "kind", ceo.alias("ceo"))
    side = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("turn")))).alias(p[0])
    grouped = parts.withColumn("turn", turn).groupBy("event_id", "block_no", "shared_keys", "shared_labels", "flags").agg(
        side("questions"), side("context"), side("procedural"), F.collect_set("flag").alias("walk_flags"), F.max(F.when(F.col("part") == "operator_before", F.col("sequence_id"))).alias("operator_before")
    )
    spoken = grouped.withColumns({"all_ceo": F.filter("c", lambda t: t["ceo"])}).filter("size(all_ceo) > 0")
    spoken = spoken.withColumns({
        "a": F.filter("all_ceo", lambda t: t["kind"] == ""),
        "moved": F.filter("all_ceo", lambda t: t["kind"] != ""),
        "others": F.filter("c", lambda t: ~t["operator"] & ~t["asks"] & ~t["ceo"]),
    })
    texts = {n: join_turns(F.transform(c, lambda t: t["text"])) for n, c in (("analyst_question", "q"), ("ceo_answer", "a"), ("answer_context", "c"))}
    spoken = spoken.withColumns(texts).withColumns({"question_word_count": word_count(F.col("analyst_question")), "ceo_answer_word_count": word_count(F.col("ceo_answer")), "answer_context_word_count": word_count(F.col("answer_context"))})
    empty = F.array().cast("array<string>")
    defect = lambda c, who: F.flatten(F.transform(c, lambda t: F.transform(procedure.source_defects(t["text"]), lambda r: F.concat(F.lit(f"{who}_"), F.upper(r), F.lit("_REVIEW")))))
    own = reasons(
        (F.size(F.array_distinct(F.transform("a", lambda t: t["speaker"]))) > 1, "MULTIPLE_CEOS_IN_ANSWER_CONTEXT"),
        (F.exists("a", lambda t: has(t["text"], r"(?:--|—)\s*\z")), "TRAILING_INTERRUPTED_CEO_TURN_REVIEW"),
        (F.exists("a", lambda t: has(t["text"], r"\((?:inaudible|technical difficult(?:y|ies))\)", True)), "CEO_SOURCE_TEXT_GAP_REVIEW"),
        (~procedure.question_candidate(F.col("analyst_question")), "ANALYST_QUESTION_APPLICABILITY_REVIEW"),
        (F.size("a") == 0, "NO_SUBSTANTIVE_CEO_TURN"),
        (F.col("question_word_count") < 8, "SHORT_ANALYST_QUESTION"),
        (F.col("ceo_answer_word_count") < 10, "SHORT_CEO_ANSWER"),
        (has(F.col("analyst_question"), roles.OPERATOR_HANDOFF, True), "QUESTION_CONTAINS_OPERATOR_HANDOFF"),
        (F.size("others") > 0, "NON_CEO_MANAGEMENT_CONTEXT"),
    )
    flags = F.concat(F.coalesce("flags", empty), F.coalesce("walk_flags", empty), defect("q", "QUESTION"), defect("a", "CEO"), own, procedure.answer_flags(F.col("ceo_answer")))
    flagged = carry_question(spoken.withColumn("block_flags", F.array_sort(F.array_distinct(flags))))
    review = F.exists("block_flags", lambda f: f.endswith("_REVIEW"))
    excluded = F.arrays_overlap("block_flags", F.array(*[F.lit(f) for f in EXCLUSION_FLAGS]))
    single = F.size("shared_keys") == 1
    tier = first_reason((review, "review"), (single & (F.size("others") == 0) & ~excluded, "high"), (single, "usable_with_flag"), default="review")
    ids = lambda c: F.transform(c, lambda t: t["sequence_id"])
    return flagged.select(
        F.format_string("ccts_%d_episode_%d", F.col("event_id"), F.col("q")[0]["sequence_id"]).alias("block_id"), "event_id", "block_no", F.col("q")[0]["label"].alias("analyst_speaker"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all_ceo", lambda t: t["label"]))), "; ").alias("ceo_speaker"), ids("q").alias("question_sequence_ids"), ids("a").alias("ceo_answer_sequence_ids"),
        ids("c").alias("context_sequence_ids"), F.array_sort(F.concat(ids("p"), ids("moved"))).alias("procedural_sequence_ids"), "question_word_count", "ceo_answer_word_count", "answer_context_word_count",
        F.size("others").alias("non_ceo_management_turn_count"), tier.alias("quality_tier"), "block_flags",
        first_reason((review, "review"), (F.size("a") == 0, "procedural_only"), default="candidate_substantive").alias("applicability_status"),
        "preceding_question_context", "analyst_question", "ceo_answer", "answer_context",
    )


def carry_question(spoken: DataFrame) -> DataFrame:
    """W-11: the question of the block before, where that ended in a counter-question to the same analyst and no
    operator spoke between; with its flag."""
    order = Window.partitionBy("event_id").orderBy("block_no")
    before = F.lag(F.struct(F.array_contains("block_flags", "UNRESOLVED_CEO_COUNTERQUESTION_REVIEW").alias("open"), F.col("q")[0]["label"].alias("label"), F.col("analyst_question").alias("question"), F.element_at("c", -1)["sequence_id"].alias("end"))).over(order)
    joined = spoken.withColumn("before", before)
    between = F.coalesce(F.col("operator_before") > F.col("before.end"), F.lit(False))
    carried = F.coalesce(F.col("before.open") & (F.col("before.label") == F.col("q")[0]["label"]) & ~between, F.lit(False))
    flagged = F.when(carried, F.array_sort(F.array_union("block_flags", F.array(F.lit("PRECEDING_QUESTION_CONTEXT_REVIEW"))))).otherwise(F.col("block_flags"))
    return joined.withColumn("preceding_question_context", F.when(carried, F.col("before.question")).otherwise("")).withColumn("block_flags", flagged).drop("before")


def event_audit(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """C-14: blocks by tier and the status of each event with anchors evidence."""
    counts = found.groupBy("event_id").agg(F.count("*").alias("eligible_ceo_qa_blocks"), F.count_if(F.col("quality_tier") == "high").alias("high_quality_blocks"))
    joined = anchors.join(counts, "event_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("eligible_ceo_qa_blocks", "high_quality_blocks")})
    status = first_reason((F.size("shared_keys") == 0, "exclude_no_same_ceo"), (F.col("eligible_ceo_qa_blocks") == 0, "review_no_ceo_answer_to_analyst_question"), (F.size("shared_keys") > 1, "review_multiple_ceo_candidates"), default="usable")
    return joined.select("event_id", "eligible_ceo_qa_blocks", "high_quality_blocks", status.alias("event_audit_status"))


def tier_counts(found: DataFrame, *by: str) -> DataFrame:
    """A-14: blocks by tier."""
    return found.groupBy(*by).agg(F.count("*").alias("blocks"), *[F.count_if(F.col("quality_tier") == t).alias(f"{t}_blocks") for t in ("high", "usable_with_flag", "review")])


_TIERS = ["candidate_block_count", "high_tier_block_count", "usable_with_flag_block_count", "review_block_count"]


def episode_tiers(tenures: DataFrame, calls: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """J-19: episodes with their confirmed events and blocks by tier; 0 where there are none.

    ``calls`` has event_id, the episode's columns ``by`` and confirmed; ``found`` event_id and quality_tier.
    """
    tiers = [F.count("quality_tier").alias(_TIERS[0]), *[F.count_if(F.col("quality_tier") == t).alias(n) for t, n in zip(("high", "usable_with_flag", "review"), _TIERS[1:], strict=True)]]
    of_event = found.groupBy("event_id").agg(*tiers)
    joined = calls.filter("confirmed").join(of_event, "event_id", "left")
    sums = joined.groupBy(*by).agg(F.count_distinct("event_id").alias("confirmed_event_count"), *[F.sum(n).alias(n) for n in _TIERS])
    names = ["confirmed_event_count", *_TIERS]
    return tenures.join(sums, by, "left").withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})


def turnover_tiers(turnovers: DataFrame, tiers: DataFrame) -> DataFrame:
    """J-19: turnovers with the counts of the old and the new episode, and whether both sides have blocks.

    ``turnovers`` has gvkey and {old,new}_{execid,tenure_episode}; ``tiers`` is of ``episode_tiers``.
    """
    names = ["confirmed_event_count", *_TIERS]
    joined = turnovers
    for side in ("old", "new"):
        of = tiers.select("gvkey", F.col("execid").alias(f"{side}_execid"), F.col("tenure_episode").alias(f"{side}_tenure_episode"), *[F.col(n).alias(f"{side}_{n}") for n in names])
        joined = joined.join(of, ["gvkey", f"{side}_execid", f"{side}_tenure_episode"], "left").withColumns({f"{side}_{n}": F.coalesce(f"{side}_{n}", F.lit(0).cast("long")) for n in names})
    return joined.withColumn("both_sides_have_candidate_blocks", (F.col("old_candidate_block_count") > 0) & (F.col("new_candidate_block_count") > 0))


def block_violations(found: DataFrame, turns: DataFrame) -> DataFrame:
    """E-4, O-5: blocks whose answers aren't in their context, whose ids aren't the event's Q&A turns, or whose texts
    the turns don't give."""
    ids = turns.filter(F.col("section") == "Q&A").groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sequence_id").cast("long").alias("k"), F.coalesce("text_contents", F.lit("")).alias("v")))).alias("texts"))
    joined = found.join(ids, "event_id", "left")
    every = F.concat("question_sequence_ids", "context_sequence_ids")
    again = lambda c: join_turns(F.transform(c, lambda s: F.try_element_at("texts", s)))
    why = reasons(
        (F.size(F.array_except("ceo_answer_sequence_ids", "context_sequence_ids")) > 0, "answer_outside_context"),
        (F.exists(every, lambda s: ~F.array_contains(F.map_keys("texts"), s)), "unknown_turn"),
        (again("question_sequence_ids") != F.col("analyst_question"), "question_differs"),
        (again("ceo_answer_sequence_ids") != F.col("ceo_answer"), "answer_differs"),
        (again("context_sequence_ids") != F.col("answer_context"), "context_differs"),
    )
    return joined.select("block_id", F.array_join(why, ";").alias("violations")).filter("violations <> ''")


def shared_answer_turns(found: DataFrame) -> DataFrame:
    """O-7: answer turns that several blocks own, with all of these."""
    each = found.select("event_id", "block_id", F.explode("ceo_answer_sequence_ids").alias("sequence_id"))
    return each.groupBy("event_id", "sequence_id").agg(F.array_sort(F.collect_set("block_id")).alias("owners")).filter("size(owners) > 1")
