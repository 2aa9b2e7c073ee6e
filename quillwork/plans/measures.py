"""Queries of the measurement stage."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import stats
from quillwork.functions.text import clean, word_count
from quillwork.operators import diagnostics, scoring
from quillwork.operators import measures as ops
from quillwork.operators import units as unit_ops
from quillwork.plans import domain
from quillwork.plans.domain import turns
from quillwork.plans.registry import query
from quillwork.storage import written
from quillwork.tables import table


@query(
    sql=r"""
WITH u AS (SELECT conv_id AS event_id, CASE WHEN role = 'system' THEN 'PRE' ELSE 'Q&A' END AS section,
                  trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations WHERE role <> 'user'),
s AS (SELECT event_id, section, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words, 1 + length(t) % 5 AS score FROM u),
a AS (SELECT event_id, sum(score * words) FILTER (section = 'PRE') / nullif(sum(words) FILTER (section = 'PRE'), 0) AS pre,
             sum(score * words) FILTER (section = 'Q&A') / nullif(sum(words) FILTER (section = 'Q&A'), 0) AS qa FROM s GROUP BY event_id)
SELECT event_id, round(pre, 6) AS pre_weighted_mean, round(qa, 6) AS qa_weighted_mean, round(qa - pre, 6) AS contrast FROM a
"""
)
def qa_minus_pre_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6, A-20, A-21: word-weighted means of a stub score by section of a call, and their difference."""
    units = turns(spark, sf_dir).filter("role <> 'user'").select("event_id", "section", word_count(F.col("text_contents")).alias("words"), (1 + F.length(clean(F.col("text_contents"))) % 5).alias("score"))
    of = lambda section: F.try_divide(F.sum(F.when(F.col("section") == section, F.col("score") * F.col("words"))), F.sum(F.when(F.col("section") == section, F.col("words"))))
    means = units.groupBy("event_id").agg(of("PRE").alias("pre"), of("Q&A").alias("qa"))
    return means.select("event_id", F.round("pre", 6).alias("pre_weighted_mean"), F.round("qa", 6).alias("qa_weighted_mean"), F.round(F.col("qa") - F.col("pre"), 6).alias("contrast"))


@query(
    f"""WITH {domain.UNITS_SQL} SELECT event_id, section, count(*) AS unit_count_total, count(score) AS unit_count_scored, CAST(sum(words) AS BIGINT) AS word_count_total, CAST(coalesce(sum(words) FILTER (score IS NOT NULL), 0) AS BIGINT) AS word_count_scored,
       round(sum(score * words) / nullif(sum(words) FILTER (score IS NOT NULL), 0)::DOUBLE, 6) AS word_weighted_mean, round(avg(score), 6) AS equal_unit_mean, median(score)::DOUBLE AS unit_median,
       round(avg(score) FILTER (words BETWEEN 50 AND 200), 6) AS common_50_200_equal_unit_mean FROM u GROUP BY 1, 2"""
)
def unit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20, M-3."""
    out = ops.unit_summary(domain.units(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("word_weighted_mean", "equal_unit_mean", "common_50_200_equal_unit_mean")}
    return out.withColumns(rounded).drop("common_50_200_word_weighted_mean", "common_50_200_unit_median")


_CALLS = f"""{domain.UNITS_SQL}, s AS (SELECT event_id, section, sum(score * words) / nullif(sum(words) FILTER (score IS NOT NULL), 0)::DOUBLE AS w, avg(score) AS e, median(score)::DOUBLE AS m, avg(score) FILTER (words BETWEEN 50 AND 200) AS c FROM u GROUP BY 1, 2),
ca AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, a.w AS pw, b.w AS qw, a.e AS pe, b.e AS qe, a.m AS pm, b.m AS qm, a.c AS pc, b.c AS qc FROM (SELECT * FROM s WHERE section = 'PRE') a FULL JOIN (SELECT * FROM s WHERE section = 'Q&A') b ON a.event_id = b.event_id)"""


@query(f"WITH {_CALLS} SELECT event_id, round(pe, 6) AS pre_equal_unit_mean, round(qe, 6) AS qa_equal_unit_mean, round(qm - pm, 6) AS qa_minus_pre_unit_median, round(qw - pw, 6) AS qa_minus_pre_word_weighted_mean, round(qc - pc, 6) AS qa_minus_pre_common FROM ca")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21."""
    m = ops.call_metrics(domain.units(spark, sf_dir))
    rounded = lambda c, to=None: F.round(c, 6).alias(to or c)
    return m.select("event_id", rounded("pre_equal_unit_mean"), rounded("qa_equal_unit_mean"), rounded("qa_minus_pre_unit_median"), rounded("qa_minus_pre_word_weighted_mean"), rounded("qa_minus_pre_common_50_200_equal_unit_mean", "qa_minus_pre_common"))


def _paired(name: str, k: str) -> str:
    both = f"p{k} IS NOT NULL AND q{k} IS NOT NULL"
    return f"""SELECT '{name}' AS measure, count(*) FILTER ({both}) AS paired_calls, round(avg(p{k}) FILTER ({both}), 6) AS pre_call_mean, round(avg(q{k}) FILTER ({both}), 6) AS qa_call_mean, round(avg(q{k} - p{k}), 6) AS qa_minus_pre_call_mean,
round(median(q{k} - p{k}), 6) AS qa_minus_pre_call_median, round(avg(p{k}), 6) AS available_pre_call_mean, round(avg(q{k}), 6) AS available_qa_call_mean FROM ca"""


@query(f"WITH {_CALLS} " + " UNION ALL ".join(_paired(n, k) for n, k in (("word_weighted_mean", "w"), ("equal_unit_mean", "e"), ("unit_median", "m"), ("common_50_200_equal_unit_mean", "c"))))
def call_metrics_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22."""
    out = ops.across_calls(ops.call_metrics(domain.units(spark, sf_dir))).filter(F.col("measure").isin("word_weighted_mean", "equal_unit_mean", "unit_median", "common_50_200_equal_unit_mean"))
    numbers = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 6) for c in numbers}).drop("pre_call_median", "qa_call_median")


_KAPPA = "1 - (SELECT sum(n * power(abs(i - j) / 4.0::DOUBLE, {p})) FROM ce) / nullif((SELECT sum(a.n * b.n * power(abs(a.i - b.j) / 4.0::DOUBLE, {p})) FROM ma a, mb b) / (SELECT sum(n) FROM ce), 0)"
_AGREE = f"""{domain.RATERS_SQL}, pr AS (SELECT human, model FROM ra WHERE human IS NOT NULL AND model IS NOT NULL), ce AS (SELECT human AS i, model AS j, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2), ma AS (SELECT i, sum(n) AS n FROM ce GROUP BY 1), mb AS (SELECT j, sum(n) AS n FROM ce GROUP BY 1),
rk AS (SELECT rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2.0 AS a, rank() OVER (ORDER BY model) + (count(*) OVER (PARTITION BY model) - 1) / 2.0 AS b FROM pr)"""


@query(
    f"""WITH {_AGREE} SELECT count(*) AS n, round(avg((human = model)::INT), 6) AS exact, round(avg((abs(human - model) <= 1)::INT), 6) AS within_one, round(avg((abs(human - model) >= 2)::INT), 6) AS two_or_more, round(avg(abs(human - model)), 6) AS mae, round(avg(model - human), 6) AS bias,
       (SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) FROM rk) AS spearman, round({_KAPPA.format(p=1)}, 6) AS linear_kappa, round({_KAPPA.format(p=2)}, 6) AS quadratic_kappa FROM pr"""
)
def agreement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23, M-4, M-5, M-6, W-7."""
    out = ops.agreement(domain.raters(spark, sf_dir))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(f"""WITH {domain.RATERS_SQL}, pr AS (SELECT doc_id % 4 AS g, human, model FROM ra WHERE model IS NOT NULL), c AS (SELECT g, human AS i, model AS j, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2, 3), t AS (SELECT g, sum(n) AS n, sum(n * power((i - j) / 4.0::DOUBLE, 2)) AS o FROM c GROUP BY 1),
e AS (SELECT a.g, sum(a.n * b.n * power((a.i - b.j) / 4.0::DOUBLE, 2)) AS e FROM (SELECT g, i, sum(n) AS n FROM c GROUP BY 1, 2) a JOIN (SELECT g, j, sum(n) AS n FROM c GROUP BY 1, 2) b ON a.g = b.g GROUP BY 1) SELECT g, CAST(n AS BIGINT) AS n, round(1 - o / (e / n), 6) AS kappa FROM t JOIN e USING (g)""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-6, by group."""
    rows = domain.raters(spark, sf_dir).withColumn("g", F.col("doc_id") % 4)
    return stats.weighted_kappa(rows, "human", "model", True, ["g"]).withColumn("kappa", F.round("kappa", 6))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-5, W-7."""
    return stats.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").select(F.round("spearman", 6).alias("spearman"))


@query("""WITH r AS (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS r FROM orders) SELECT o_orderkey, r::DOUBLE AS average_rank FROM r""")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7."""
    return table(spark, sf_dir, "orders").select("o_orderkey", stats.average_rank("o_custkey", "o_orderstatus").alias("average_rank"))


@query(f"""WITH {domain.RATERS_SQL}, c AS (SELECT doc_id % 50 AS event_id, avg(human) FILTER (doc_id % 2 = 0) - avg(human) FILTER (doc_id % 2 = 1) AS h, avg(model) FILTER (doc_id % 3 = 0) - avg(model) FILTER (doc_id % 3 = 1) AS m FROM ra GROUP BY 1)
SELECT count(*) AS calls, round(avg(abs(m - h)), 6) AS mae, round(avg(m - h), 6) AS bias, round(avg((sign(m) = sign(h))::INT), 6) AS same_sign FROM c WHERE h IS NOT NULL AND m IS NOT NULL""")
def contrast_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21, J-12."""
    rows, k = domain.raters(spark, sf_dir), F.col("doc_id")
    mean = lambda c, n, r: F.avg(F.when(k % n == r, F.col(c)))
    both = rows.groupBy((k % 50).alias("event_id")).agg((mean("human", 2, 0) - mean("human", 2, 1)).alias("h"), (mean("model", 3, 0) - mean("model", 3, 1)).alias("m"))
    out = ops.contrast_agreement(both.select("event_id", F.col("h").alias("d")), both.select("event_id", F.col("m").alias("d")), "d")
    return out.select("calls", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "same_sign")])


@query(f"""WITH {domain.RATERS_SQL} SELECT doc_id, human, model FROM ra WHERE model IS NOT NULL""")
def paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11."""
    rows = domain.raters(spark, sf_dir)
    return ops.paired_labels(rows.select("doc_id", F.col("human").alias("score")), rows.select("doc_id", F.col("model").alias("score")), "doc_id")


_ATTEMPTS = """att AS (SELECT user_id || '_' || event_type AS custom_id, event_id, ts, event_type <> 'error' AND event_id % 3 <> 0 AS valid, event_id % 3 = 0 AS retryable, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
rc AS (SELECT custom_id, count(*) AS attempts, bool_or(valid) FILTER (k = 1) AS first_valid, arg_max(valid, k) AS final_valid, bool_or(retryable) FILTER (k = 1) AS r1 FROM att GROUP BY 1),
re AS (SELECT custom_id, attempts, first_valid, final_valid, CASE WHEN attempts > 2 THEN 'third_attempt' WHEN attempts = 2 AND NOT r1 THEN 'retry_without_technical_failure' ELSE '' END AS violation FROM rc)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("custom_id"), "event_id", "ts", ((F.col("event_type") != "error") & (k % 3 != 0)).alias("valid"), (k % 3 == 0).alias("retryable"))
    numbered = scoring.number_attempts(rows, ["custom_id"], ["ts", "event_id"])
    reason = F.lit("inference_error")
    given = numbered.withColumns({"reason": reason, "retry_reason": F.when(F.col("attempt_number") > 1, reason)})
    return scoring.reconcile_attempts(given, ["ts", "event_id"])


@query(f"WITH {_ATTEMPTS} SELECT * FROM re")
def attempt_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-8."""
    return _reconciled(spark, sf_dir)


@query(f"WITH {_ATTEMPTS} SELECT CAST(sum(attempts) AS BIGINT) AS total_attempt_records, count(*) AS unique_request_ids, count(*) FILTER (attempts = 2) AS retried_ids, count(*) FILTER (NOT first_valid) AS first_attempt_invalid_ids, count(*) FILTER (violation <> '') AS violations FROM re")
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25."""
    return scoring.attempt_ledger(_reconciled(spark, sf_dir))


@query("""WITH l AS (SELECT l_orderkey, min(l_linestatus) AS s, min(l_returnflag) AS f, max(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS requested, count(*) FILTER (o_orderkey IS NOT NULL AND s = 'F') AS completed, count(*) FILTER (f = 'R' AND s <> 'F') AS errors, count(*) FILTER (o_orderkey IS NOT NULL AND s = 'F' AND d > 0.05) AS valid,
       (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing, count(*) FILTER (o_orderkey IS NULL) AS unexpected FROM l LEFT JOIN orders ON o_orderkey = l_orderkey""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, J-13."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("f"), F.max("l_discount").alias("d"))
    status = F.when(F.col("s") == "F", "completed").when(F.col("f") == "R", "error").otherwise("rejected")
    results = lines.select(F.col("l_orderkey").alias("custom_id"), status.alias("status"), ((F.col("s") == "F") & (F.col("d") > 0.05)).alias("valid"))
    return scoring.run_counters(requests, results)


@query(f"""WITH {domain.RATERS_SQL}, p AS (SELECT human % 4 <> 0 AS v1, model IS NOT NULL AS v2, human, model FROM ra) SELECT count(*) AS requests, count(*) FILTER (v1 AND v2) AS valid_pairs, count(*) FILTER (v1 AND v2 AND human > 1 AND model > 1) AS score_pairs,
       count(*) FILTER (v1 AND v2 AND human = model) AS exact_output, count(*) FILTER (v1 AND v2 AND human > 1 AND model > 1 AND human = model) AS exact_score, round(count(*) FILTER (v1 AND v2 AND human > 1 AND model > 1 AND human = model)::DOUBLE / count(*) FILTER (v1 AND v2 AND human > 1 AND model > 1), 6) AS exact_score_rate FROM p""")
def repeat_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24, J-14."""
    rows = domain.raters(spark, sf_dir)
    side = lambda c, valid: rows.select(F.col("doc_id").alias("custom_id"), valid.alias("valid"), (F.coalesce(F.col(c), F.lit(0)) > 1).cast("int").alias("ok"), F.col(c).alias("score"), F.col(c).cast("string").alias("raw"))
    out = scoring.repeat_agreement(side("human", F.col("human") % 4 != 0), side("model", F.col("model").isNotNull()))
    return out.withColumn("exact_score_rate", F.round("exact_score_rate", 6))


@query("""SELECT conv_id || '_' || turn AS custom_id, 'completed' AS status, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END AS ok, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 + length(text) % 5 END AS specificity, '' AS score_error FROM conversations""")
def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1, N-7, P-10: the stub scorer's answers, parsed strictly."""
    requests = table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    out = scoring.score_requests(requests, scoring.stub_scorer, "id", "text").withColumn("parsed", scoring.strict_json(F.col("raw_output")))
    answer = F.from_json("parsed", "ok int, specificity int")
    return out.select("custom_id", "status", answer["ok"].alias("ok"), answer["specificity"].alias("specificity"), scoring.score_error(F.col("parsed")).alias("score_error"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS strict FROM events""")
def strict_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-7, SRC-10; what Spark's parser lets through is fixture-tested."""
    parsed = scoring.strict_json(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(parsed, "$.k").alias("k"), parsed.isNotNull().alias("strict"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'scored' WHEN toxic = 0 THEN 'procedural_only' ELSE 'source_uninterpretable' END AS state, CASE WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 0 END AS ok, CASE WHEN quality = 1 THEN CAST(doc_id % 5 + 1 AS INTEGER) END AS score FROM labels""")
def label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-9."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    kind = F.when(good, "substantive").when(toxic, "uncertain").otherwise("procedural_only")
    state = scoring.label_state(kind, F.when(good, 1).when(~toxic, 0), F.when(good, F.col("doc_id") % 5 + 1).when(~toxic, 0), F.lit("note"))
    return table(spark, sf_dir, "labels").select("doc_id", state.alias("s")).select("doc_id", "s.state", "s.ok", "s.score")


_COVER = f"""{domain.UNITS_SQL}, g AS (SELECT event_id, count(*) FILTER (section = 'PRE') AS pre_unit_count, CAST(coalesce(sum(words) FILTER (section = 'PRE'), 0) AS BIGINT) AS pre_scored_word_count, count(*) FILTER (section = 'Q&A' AND sequence_id % 4 <> 2) AS high_qa_unit_count,
       CAST(coalesce(sum(words) FILTER (section = 'Q&A' AND sequence_id % 4 <> 2), 0) AS BIGINT) AS high_qa_scored_word_count, CAST(coalesce(sum(words) FILTER (section = 'Q&A'), 0) AS BIGINT) AS qa_ceo_word_count FROM u GROUP BY 1),
cv AS (SELECT *, round(high_qa_scored_word_count / nullif(qa_ceo_word_count, 0)::DOUBLE, 6) AS high_qa_word_coverage, pre_unit_count > 0 AND high_qa_unit_count > 0 AS primary_specificity_call_eligible,
       pre_unit_count > 0 AND high_qa_unit_count >= 2 AND high_qa_scored_word_count >= 100 AND coalesce(high_qa_scored_word_count >= 0.25 * nullif(qa_ceo_word_count, 0), false) AS qa_quality_screen_call_eligible FROM g)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = domain.units(spark, sf_dir).withColumnRenamed("words", "unit_word_count")
    calls = u.groupBy("event_id").agg(F.coalesce(F.sum(F.when(F.col("section") == "Q&A", F.col("unit_word_count"))), F.lit(0).cast("long")).alias("qa_ceo_word_count"))
    return unit_ops.call_coverage(calls, u.filter("section = 'PRE'"), u.filter("section = 'Q&A' and sequence_id % 4 <> 2"))


@query(f"WITH {_COVER} SELECT * FROM cv")
def call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17."""
    return _coverage(spark, sf_dir).withColumn("high_qa_word_coverage", F.round("high_qa_word_coverage", 6))


@query(f"WITH {_COVER}, e AS (SELECT event_id % 6 AS episode, count(*) AS n FROM cv WHERE primary_specificity_call_eligible GROUP BY 1 HAVING count(*) >= 2) SELECT (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM (SELECT DISTINCT event_id % 6 AS o, (event_id + 1) % 6 AS n FROM cv) WHERE o IN (SELECT episode FROM e) AND n IN (SELECT episode FROM e)) AS turnovers")
def eligible_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18."""
    cover, k = _coverage(spark, sf_dir), F.col("event_id")
    pairs = cover.select((k % 6).alias("old_episode"), ((k + 1) % 6).alias("new_episode")).distinct()
    return unit_ops.eligible_support(cover.withColumn("episode", k % 6), "primary_specificity_call_eligible", "episode", pairs, 2)


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored units of two sections and three periods: the conversations' turns."""
    docs = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 100 + F.col("turn"))
    k, words = F.col("doc_id"), word_count(F.col("text"))
    return docs.select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("period_bin"), F.when(k % 2 == 0, "PRE").otherwise("Q&A").alias("section"), k.alias("unit_id"), words.alias("words"), (1 + F.length("text") % 5).alias("score"))


@query()
def length_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-8."""
    return diagnostics.length_matches(written(_evaluation(spark, sf_dir), "evaluation"))  # texts are read once


@query()
def hc3_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-9."""
    return diagnostics.length_regression(_evaluation(spark, sf_dir), interaction=True)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-7."""
    rows = _evaluation(spark, sf_dir).withColumn("side", F.when(F.col("section") == "PRE", "pre").otherwise("qa"))
    return diagnostics.bootstrap(rows, "score", "side")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("audit_id"), F.when(good, "substantive").when(toxic, "uncertain").otherwise("procedural_only").alias("content_class"), F.when(good, 1).when(~toxic, 0).alias("ok"),
        F.when(good, F.col("doc_id") % 5 + 1).when(~toxic, 0).alias("score"), F.lit("note").alias("note"),
    )


@query("""SELECT doc_id AS audit_id, CASE WHEN quality = 1 THEN 'scored' WHEN toxic = 0 THEN 'procedural_only' ELSE 'source_uninterpretable' END AS reference_state, NOT (quality = 0 AND toxic = 1) AS include_primary_eligibility, quality = 1 AS include_primary_numeric,
       NOT (doc_id % 4 = 0 AND quality = 1 AND doc_id % 8 <> 0) AND doc_id % 5 <> 1 AS as_submitted FROM labels""")
def reference_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-9, C-15: every fourth class was submitted otherwise, every eighth revised, every fifth row is missing."""
    labels = _labels(spark, sf_dir)
    other = F.when((F.col("audit_id") % 4 == 0) & (F.col("ok") == 1), "mixed").otherwise(F.col("content_class"))
    submitted = labels.filter("audit_id % 5 <> 1").withColumn("content_class", other)
    return scoring.reference_ledger(labels, submitted, labels.filter("audit_id % 8 = 0"))


@query("""SELECT (SELECT count(*) FROM documents) AS total, count(*) AS reviewed, count(*) FILTER (quality = 1) AS scored, count(*) FILTER (quality = 0 AND toxic = 1) AS source_missing, count(*) FILTER (quality = 0 AND toxic = 0) AS procedural_only, (SELECT count(*) FROM documents) - count(*) AS remaining,
       (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS pre_total, (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS qa_total, count(*) FILTER (quality = 1 AND doc_id % 2 = 0) AS pre_scored, count(*) FILTER (quality = 1 AND doc_id % 2 = 1) AS qa_scored,
       count(*) FILTER (doc_id % 2 = 0) AS pre_reviewed, count(*) FILTER (doc_id % 2 = 1) AS qa_reviewed FROM labels JOIN documents USING (doc_id)""")
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26."""
    k = F.col("doc_id")
    units_ = table(spark, sf_dir, "documents").select(k.alias("audit_id"), F.when(k % 2 == 0, "pre").otherwise("qa").alias("unit_type"))
    labels = _labels(spark, sf_dir)
    states = labels.select("audit_id", scoring.label_state(F.col("content_class"), F.col("ok"), F.col("score"), F.col("note"))["state"].alias("state"))
    return scoring.annotation_progress(units_, states)


@query("""SELECT doc_id AS custom_id, CASE WHEN doc_id % 10 = 0 THEN 'no_request' WHEN doc_id % 7 = 0 THEN 'text_differs' ELSE 'word_count_differs' END AS violation FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def unit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, J-15."""
    k, text = F.col("doc_id"), F.col("text")
    docs = table(spark, sf_dir, "documents")
    units_ = docs.select(k.alias("custom_id"), "text", F.when(k % 11 == 0, -1).otherwise(word_count(text)).alias("word_count"), F.sha2(text, 256).alias("sha256"))
    requests = docs.filter(k % 10 != 0).select(k.alias("custom_id"), F.when(k % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("request_text"))
    return scoring.unit_violations(units_, requests)


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 3 = 0 AS r FROM events), s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 UNION ALL SELECT -1), f AS (SELECT user_id, r FROM a WHERE k = 1)
SELECT s.user_id AS custom_id, CASE WHEN s.user_id = -1 THEN 'unknown_request' ELSE 'not_retryable' END AS violation FROM s LEFT JOIN f USING (user_id) WHERE s.user_id = -1 OR NOT r UNION ALL SELECT user_id, 'second_without_reservation' FROM a WHERE k = 2 AND user_id % 2 = 1""")
def retry_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-8."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("custom_id"), "event_id", "ts", (F.col("event_id") % 3 == 0).alias("retryable"), F.lit("inference_error").alias("reason"))
    attempts = scoring.number_attempts(rows, ["custom_id"], ["ts", "event_id"])
    requests = rows.select("custom_id").distinct()
    held = requests.filter("custom_id % 2 = 0").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("custom_id"))).withColumn("retry_reason", F.lit("inference_error"))
    return scoring.reservation_violations(attempts, held, requests)


@query("""SELECT event_id AS custom_id, sha256(event_type) AS run_binding_sha256 FROM events WHERE event_type <> 'click'""")
def run_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-9, U-2."""
    results = table(spark, sf_dir, "events").select(F.col("event_id").alias("custom_id"), F.sha2("event_type", 256).alias("run_binding_sha256"))
    return scoring.provenance_violations(results, hashlib.sha256(b"click").hexdigest())
