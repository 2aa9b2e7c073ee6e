"""Scoring through a given function, result validity, attempts (U-1, P-9 to P-11, R-8, A-24, A-25, A-28, N-3, N-7 to N-9)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillwork.functions.text import first_reason, word_count


def strict_loads(text: str):
    """N-7: JSON without repeated keys, NaN, infinities, floats that overflow, or anything around it; else ValueError."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key repeats")
        return out

    def number(digits: str) -> float:
        value = float(digits)
        if not math.isfinite(value):
            raise ValueError("a number overflows")
        return value

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=refuse)


def sequence_ids(text: str | None) -> list[str]:
    """N-3: the ids in a cell that holds a JSON list of them; one that isn't all digits or repeats is a ValueError."""
    try:
        values = json.loads(str(text))
    except ValueError as e:
        raise ValueError("no JSON in a sequence list") from e
    if not isinstance(values, list) or not all(str(v).isdigit() for v in values):
        raise ValueError("no sequence list")
    ids = [str(v) for v in values]
    if len(set(ids)) != len(ids):
        raise ValueError("a sequence id repeats")
    return ids


def require_schema(schema: object, expected: dict) -> None:
    """N-8: a ValueError unless the schema is the expected one, in any order of keys and with any title, $schema and
    description at its top."""
    if not isinstance(schema, dict):
        raise ValueError("missing response schema")
    structural = {k: v for k, v in schema.items() if k not in ("title", "$schema", "description")}
    if json.dumps(structural, sort_keys=True, allow_nan=False) != json.dumps(expected, sort_keys=True, allow_nan=False):
        raise ValueError("unsupported response schema")


@F.pandas_udf(StringType())
def strict_json(s: pd.Series) -> pd.Series:
    """N-7: the JSON text with sorted keys if it is strict, else null. Spark's parsers take repeated keys or trailing
    text, so this is Python."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(strict_loads(text), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return s.map(one)


def score_error(parsed: Column) -> Column:
    """P-10: what is wrong with a canonical score JSON, '' if nothing: keys ok and specificity only, both true integers,
    ok 0 or 1, specificity 0 to 5, and both 0 or neither."""
    ok, score = F.regexp_extract(parsed, r'\A\{"ok":(-?\d+),"specificity":(-?\d+)\}\z', 1), F.regexp_extract(parsed, r'\A\{"ok":(-?\d+),"specificity":(-?\d+)\}\z', 2)
    keys = F.coalesce(F.array_join(F.array_sort(F.json_object_keys(parsed)), ","), F.lit(""))
    return first_reason(
        (parsed.isNull(), "not strict JSON"), (keys != "ok,specificity", "output keys are not exactly ok,specificity"),
        (~ok.isin("0", "1"), "ok is not integer 0 or 1"), (~score.isin(*"012345"), "specificity is not integer 0 through 5"),
        ((ok == "0") != (score == "0"), "ok=0 requires specificity=0; ok=1 requires specificity 1 through 5"), default="",
    )


def result_error(raw: Column, stored: Column) -> Column:
    """P-11: why a result row is not valid, '' if it is. ``raw`` and ``stored`` are its output and stored answer as
    canonical JSON; the row's evidence columns are read by name."""
    c = F.col
    ids = c("generated_token_ids")
    last = F.try_element_at(ids, F.lit(-1))
    body = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))
    tokens = (
        F.coalesce(F.size(ids), F.lit(0)) > 0) & (last == c("terminal_eos_token_id")) & F.array_contains("configured_eos_token_ids", c("terminal_eos_token_id")) & F.array_contains("tokenizer_special_token_ids", c("terminal_eos_token_id")) & ~F.exists(body, lambda t: F.array_contains("tokenizer_special_token_ids", t)) & F.forall(ids, lambda t: t >= 0)
    decoded = (c("terminal_eos_text") != "") & (c("raw_output_with_special_tokens") == F.concat("raw_output", "terminal_eos_text"))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    score = score_error(raw)
    return (
        F.when(no(c("status") == "completed") | c("validation_error").isNotNull(), F.coalesce("validation_error", F.lit("output status is not completed")))
        .when(no(~c("output_truncated")) | no(c("finish_reason") == "eos_token"), "missing or invalid EOS termination evidence")
        .when(no(~c("input_truncated")) | no(~c("input_context_rejected")), "input truncation/rejection evidence missing or invalid")
        .when(no(tokens), "invalid generated-token/EOS evidence")
        .when(no(decoded), "full decoded response differs from payload plus terminal EOS")
        .when(score != "", score)
        .when(no(raw == stored), "stored parsed output differs from strict whole-raw parse")
        .otherwise("")
    )


def label_state(content_class: Column, ok: Column, score: Column, note: Column) -> Column:
    """P-9: struct (state, ok, score) of a human label: scored, procedural_only or source_uninterpretable; all else is
    an error."""
    text = lambda x: F.trim(F.coalesce(x.cast("string"), F.lit("")))
    kind, ok, score = text(content_class), text(ok), text(score)
    known = kind.isin("substantive", "mixed", "procedural_only", "uncertain")
    row = lambda state, o, s: F.struct(F.lit(state).alias("state"), o.alias("ok"), s.alias("score"))
    null = F.lit(None).cast("int")
    fail = F.raise_error(F.lit("inconsistent or unfinished human reference")).cast("struct<state:string,ok:int,score:int>")
    return (
        F.when(known & (kind == "uncertain") & (ok == "") & (score == "") & (text(note) != ""), row("source_uninterpretable", null, null))
        .when((kind == "procedural_only") & (ok == "0") & (score == "0"), row("procedural_only", F.lit(0), null))
        .when(known & (kind != "procedural_only") & (ok == "1") & score.isin(*"12345"), row("scored", F.lit(1), score.try_cast("int")))
        .otherwise(fail)
    )


def request_violations(requests: DataFrame) -> DataFrame:
    """N-9: requests without an id, or whose messages aren't one system and one user message with content."""
    roles = F.transform("messages", lambda m: m["role"])
    why = F.concat_ws(";", F.when(F.trim(F.coalesce("custom_id", F.lit(""))) == "", "no_id"), F.when(~F.coalesce(roles == F.array(F.lit("system"), F.lit("user")), F.lit(False)), "messages"), F.when(F.exists("messages", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "empty_content"))
    return requests.select("custom_id", why.alias("violations")).filter("violations <> ''")


def score_requests(requests: DataFrame, scorer: Callable[[pd.Series], pd.Series], id_col: str, text_col: str, max_chars: int = 1 << 20) -> DataFrame:
    """U-1: one result row for each request: a longer text is rejected, never cut, and an error stays in its row.

    ``scorer`` gets texts and returns JSON answers; it runs in batches on the executors.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = batch["text"].fillna("")
            fits = text.str.len() <= max_chars
            out = pd.DataFrame({"custom_id": batch["custom_id"], "status": "rejected", "raw_output": None, "validation_error": "input context limit"})
            try:
                out.loc[fits, "raw_output"] = scorer(text[fits])
                out.loc[fits, ["status", "validation_error"]] = ["completed", None]
            except Exception as e:  # an error is a row's status, and the run's counters show it
                out.loc[fits, "status"], out.loc[fits, "validation_error"] = "error", str(e)[:500]
            yield out

    picked = requests.select(F.col(id_col).cast("string").alias("custom_id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(apply, "custom_id string, status string, raw_output string, validation_error string")


def stub_scorer(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: 1 plus the length modulo 5; 0 for empty text."""
    score = (1 + texts.str.len() % 5).where(texts != "", 0)
    return score.map(lambda s: json.dumps({"ok": int(s > 0), "specificity": int(s)}))


def reconcile_attempts(attempts: DataFrame, order: list[str]) -> DataFrame:
    """R-8: each id's attempts summed up: the last one, whether a second was allowed, and the violations.

    ``attempts`` has custom_id, valid, retryable (a technical failure), retry_reason (null on the first), reason (what
    a retry of it must name). A second needs a retryable first; a third is never allowed. The choice is by order only.
    """
    row = F.struct(*order, "valid", "retryable", "retry_reason", "reason")
    grouped = attempts.groupBy("custom_id").agg(F.count("*").alias("attempts"), F.slice(F.array_sort(F.collect_list(row)), 1, 2).alias("a"), F.max(row).alias("last"))
    first, second = F.col("a")[0], F.get("a", F.lit(1))
    why = first_reason(
        (F.col("attempts") > 2, "third_attempt"), (first["retry_reason"].isNotNull(), "first_claims_retry"), ((F.col("attempts") == 2) & ~first["retryable"], "retry_without_technical_failure"),
        ((F.col("attempts") == 2) & ~second["retry_reason"].eqNullSafe(first["reason"]), "retry_reason_differs"), default="",
    )
    return grouped.select("custom_id", "attempts", first["valid"].alias("first_valid"), F.col("last.valid").alias("final_valid"), why.alias("violation"))


def attempt_ledger(reconciled: DataFrame) -> DataFrame:
    """A-25: one row of totals."""
    return reconciled.agg(F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("total_attempt_records"), F.count("*").alias("unique_request_ids"), F.count_if(F.col("attempts") == 2).alias("retried_ids"), F.count_if(~F.col("first_valid")).alias("first_attempt_invalid_ids"), F.count_if(F.col("violation") != "").alias("violations"))


def run_counters(requests: DataFrame, results: DataFrame) -> DataFrame:
    """A-28, J-13: one row: requested, completed, errors, valid, missing and unexpected results."""
    joined = requests.select(F.col("custom_id").alias("r")).join(results.select(F.col("custom_id").alias("o"), "status", "valid"), F.col("r") == F.col("o"), "full_outer")
    return joined.agg(
        F.count("r").alias("requested"), F.count_if(F.col("r").isNotNull() & (F.col("status") == "completed")).alias("completed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("r").isNotNull() & F.col("valid")).alias("valid"), F.count_if(F.col("o").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("unexpected"),
    )


def repeat_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """A-24, J-14: one row over the ids of ``first`` (custom_id, valid, ok, score, raw): comparable pairs and equal ones,
    each with its own denominator. Equal failures are not agreement."""
    right = second.select(F.col("custom_id").alias("c2"), F.col("valid").alias("v2"), F.col("ok").alias("o2"), F.col("score").alias("s2"), F.col("raw").alias("r2"))
    joined = first.join(right, F.col("custom_id") == F.col("c2"), "left")
    pair = F.col("valid") & F.coalesce("v2", F.lit(False))
    scored = pair & (F.col("ok") == 1) & (F.col("o2") == 1)
    share = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    return joined.agg(
        F.count("*").alias("requests"), F.count_if(pair).alias("valid_pairs"), F.count_if(scored).alias("score_pairs"), F.count_if(pair & (F.col("raw") == F.col("r2"))).alias("exact_output"),
        F.count_if(scored & (F.col("score") == F.col("s2"))).alias("exact_score"), share(scored & (F.col("score") == F.col("s2")), scored).alias("exact_score_rate"),
    )


def number_attempts(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """attempt_number of each row within its key."""
    return events.withColumn("attempt_number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def reservation_violations(attempts: DataFrame, reservations: DataFrame, requests: DataFrame) -> DataFrame:
    """R-8: reservations of unknown requests, or whose first attempt isn't retryable for their reason; and second
    attempts without one. ``attempts`` has custom_id, attempt_number, retryable, reason; ``reservations`` custom_id,
    retry_reason."""
    first = attempts.filter("attempt_number = 1").select("custom_id", "retryable", "reason")
    held = reservations.join(requests.select("custom_id", F.lit(True).alias("known")), "custom_id", "left").join(first, "custom_id", "left")
    why = F.when(F.col("known").isNull(), "unknown_request").when(~F.coalesce("retryable", F.lit(False)), "not_retryable").when(~F.col("retry_reason").eqNullSafe(F.col("reason")), "reason_differs")
    bad = held.select("custom_id", why.alias("violation")).filter("violation is not null")
    unreserved = attempts.filter("attempt_number = 2").join(reservations, "custom_id", "left_anti").select("custom_id", F.lit("second_without_reservation").alias("violation"))
    return bad.unionByName(unreserved)


def provenance_violations(results: DataFrame, binding: str) -> DataFrame:
    """R-9, U-2: result rows that another run's binding made, or none."""
    return results.filter(~F.col("run_binding_sha256").eqNullSafe(F.lit(binding))).select("custom_id", "run_binding_sha256")


def unit_violations(units: DataFrame, requests: DataFrame) -> DataFrame:
    """J-10, J-15: units (custom_id, text, word_count, sha256) that their request (custom_id, request_text) doesn't
    equal, or that have none, or the reverse."""
    joined = units.join(requests.select(F.col("custom_id").alias("r"), "request_text"), F.col("custom_id") == F.col("r"), "full_outer")
    why = (
        F.when(F.col("r").isNull(), "no_request").when(F.col("custom_id").isNull(), "no_unit").when(F.col("text") != F.col("request_text"), "text_differs")
        .when(F.sha2("request_text", 256) != F.col("sha256"), "hash_differs").when(word_count(F.col("request_text")) != F.col("word_count"), "word_count_differs")
    )
    return joined.select(F.coalesce("custom_id", "r").alias("custom_id"), why.alias("violation")).filter("violation is not null")


def reference_ledger(labels: DataFrame, submitted: DataFrame, revisions: DataFrame) -> DataFrame:
    """C-15, R-13: each label (audit_id, content_class, ok, score, note) with its state, what of it is used, and whether
    it is the submitted one (audit_id, content_class, ok, score) after the authorised revisions of classes."""
    state = label_state(F.col("content_class"), F.col("ok"), F.col("score"), F.col("note"))
    s = submitted.select(F.col("audit_id").alias("a"), F.col("content_class").alias("c0"), F.col("ok").alias("o0"), F.col("score").alias("s0"))
    v = revisions.select(F.col("audit_id").alias("b"), F.col("content_class").alias("c1"))
    joined = labels.withColumn("st", state).join(s, F.col("audit_id") == F.col("a"), "left").join(v, F.col("audit_id") == F.col("b"), "left")
    same = F.col("a").isNotNull() & F.col("ok").eqNullSafe(F.col("o0")) & F.col("score").eqNullSafe(F.col("s0")) & F.col("content_class").eqNullSafe(F.coalesce("c1", "c0"))
    return joined.select("audit_id", F.col("st.state").alias("reference_state"), (F.col("st.state") != "source_uninterpretable").alias("include_primary_eligibility"), (F.col("st.state") == "scored").alias("include_primary_numeric"), same.alias("as_submitted"))


def annotation_progress(units: DataFrame, labels: DataFrame) -> DataFrame:
    """A-26: one row of totals over units (audit_id, unit_type) and their labels (audit_id, state)."""
    joined = units.join(labels.select("audit_id", "state"), "audit_id", "left")
    done, scored = F.col("state").isNotNull(), F.col("state") == "scored"
    of = lambda t: F.col("unit_type") == t
    return joined.agg(
        F.count("*").alias("total"), F.count_if(done).alias("reviewed"), F.count_if(scored).alias("scored"), F.count_if(F.col("state") == "source_uninterpretable").alias("source_missing"), F.count_if(F.col("state") == "procedural_only").alias("procedural_only"),
        F.count_if(~done).alias("remaining"), *[F.count_if(of(t)).alias(f"{t}_total") for t in ("pre", "qa")], *[F.count_if(of(t) & scored).alias(f"{t}_scored") for t in ("pre", "qa")], *[F.count_if(of(t) & done).alias(f"{t}_reviewed") for t in ("pre", "qa")],
    )
