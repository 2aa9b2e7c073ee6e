"""Call-level measures: unit summaries, contrasts, paired aggregates, agreement (A-20 to A-23, J-11, J-12, M-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.stats import pearson, rank_table, weighted_kappa

COMMON = (50, 200)
MEASURES = ["word_weighted_mean", "equal_unit_mean", "unit_median", "common_50_200_word_weighted_mean", "common_50_200_equal_unit_mean", "common_50_200_unit_median"]


def weighted_mean(score: Column, weight: Column) -> Column:
    """M-3: null without weight."""
    return F.try_divide(F.sum(F.when(score.isNotNull(), score * weight)).cast("double"), F.sum(F.when(score.isNotNull(), weight)).cast("double"))


def summaries(score: Column, words: Column) -> dict[str, Column]:
    """The six measures of a group; the last three over units of COMMON words. Medians are exact."""
    common = F.when(words.between(*COMMON), score)
    out = {}
    for prefix, s in (("", score), ("common_50_200_", common)):
        out |= {f"{prefix}word_weighted_mean": weighted_mean(s, words), f"{prefix}equal_unit_mean": F.avg(s), f"{prefix}unit_median": F.median(s)}
    return out


def unit_summary(units: DataFrame) -> DataFrame:
    """A-20: a row for each event and section (event_id, section, words, score; null: not scored)."""
    score, words = F.col("score"), F.col("words")
    counts = [F.count("*").alias("unit_count_total"), F.count(score).alias("unit_count_scored"), F.sum(words).alias("word_count_total"), F.coalesce(F.sum(F.when(score.isNotNull(), words)), F.lit(0).cast("long")).alias("word_count_scored")]
    return units.groupBy("event_id", "section").agg(*counts, *[c.alias(n) for n, c in summaries(score, words).items()])


def call_metrics(units: DataFrame) -> DataFrame:
    """A-21: a row for each event with both sections' measures and Q&A minus PRE, null where a side is."""
    aggregates = []
    for prefix, section in (("pre", "PRE"), ("qa", "Q&A")):
        score = F.when(F.col("section") == section, F.col("score"))
        aggregates += [c.alias(f"{prefix}_{n}") for n, c in summaries(score, F.col("words")).items()]
    calls = units.groupBy("event_id").agg(*aggregates)
    return calls.withColumns({f"qa_minus_pre_{n}": F.col(f"qa_{n}") - F.col(f"pre_{n}") for n in MEASURES})


def across_calls(calls: DataFrame) -> DataFrame:
    """A-22: a row for each measure over the calls that have both sides, and means over those that have one."""
    rows = calls.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"pre_{n}").alias("pre"), F.col(f"qa_{n}").alias("qa"), F.col(f"qa_minus_pre_{n}").alias("diff")) for n in MEASURES])))
    both = F.col("diff").isNotNull()
    paired = {c: F.when(both, F.col(c)) for c in ("pre", "qa", "diff")}
    names = {"pre": "pre_call", "qa": "qa_call", "diff": "qa_minus_pre_call"}
    aggregates = [f(paired[c]).alias(f"{n}_{s}") for c, n in names.items() for s, f in (("mean", F.avg), ("median", F.median))]
    return rows.groupBy("measure").agg(F.count_if(both).alias("paired_calls"), *aggregates, F.avg("pre").alias("available_pre_call_mean"), F.avg("qa").alias("available_qa_call_mean"))


def agreement(pairs: DataFrame, a: str = "human", b: str = "model") -> DataFrame:
    """A-23: one row over pairs of scores: exact, within one and two or more apart, mean absolute error and bias,
    Spearman, linear and quadratic kappa."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    rate = lambda c: F.avg(c.cast("double"))
    basic = both.agg(F.count("*").alias("n"), rate(gap == 0).alias("exact"), rate(gap <= 1).alias("within_one"), rate(gap >= 2).alias("two_or_more"), F.avg(gap).alias("mae"), F.avg(F.col("b") - F.col("a")).alias("bias"))
    ranked = rank_table(rank_table(both, "a", "ra"), "b", "rb").agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"))
    kappas = [weighted_kappa(both, "a", "b", q).select(F.col("kappa").alias(n)) for q, n in ((False, "linear_kappa"), (True, "quadratic_kappa"))]
    out = basic
    for one in (ranked, *kappas):
        out = out.join(one, how="left", on=F.lit(True))  # one row each
    return out


def paired_labels(human: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """J-11: units that a human and the model both scored."""
    h = human.filter("score is not null").select(key, F.col("score").alias("human"))
    m = model.filter("score is not null").select(key, F.col("score").alias("model"))
    return h.join(m, key)


def contrast_agreement(human: DataFrame, model: DataFrame, measure: str = "qa_minus_pre_word_weighted_mean") -> DataFrame:
    """J-12: one row over calls with both contrasts: calls, mean absolute error, bias, share of equal sign, Spearman."""
    both = human.select("event_id", F.col(measure).alias("h")).join(model.select("event_id", F.col(measure).alias("m")), "event_id").filter("h is not null and m is not null")
    basic = both.agg(F.count("*").alias("calls"), F.avg(F.abs(F.col("m") - F.col("h"))).alias("mae"), F.avg(F.col("m") - F.col("h")).alias("bias"), F.avg((F.signum("m") == F.signum("h")).cast("double")).alias("same_sign"))
    rank = rank_table(rank_table(both, "h", "rh"), "m", "rm").agg(pearson(F.col("rh"), F.col("rm")).alias("spearman"))
    return basic.join(rank, how="left", on=F.lit(True))
