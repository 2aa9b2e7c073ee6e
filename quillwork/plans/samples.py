"""Queries of deterministic samples; their sizes are the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.dates import any_date, period_bin, quarter_text, year_in
from quillwork.functions.text import word_count
from quillwork.operators import sampling
from quillwork.plans.registry import query
from quillwork.tables import table

SEED = 20260720


@query(f"""WITH k AS (SELECT o_orderkey, sha256('{SEED}|calls|' || o_orderkey) AS sample_key FROM orders) SELECT o_orderkey, sample_key, row_number() OVER (ORDER BY sample_key, o_orderkey) AS sample_rank FROM k QUALIFY sample_rank <= 100""")
def hash_order_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-2, W-8."""
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), SEED, "calls", "o_orderkey", 100)


@query("""WITH c AS (SELECT o_orderpriority || '|' || o_orderstatus AS stratum, count(*) AS available FROM orders GROUP BY 1) SELECT stratum, available, 10 + (200 - 150) // 15 + CASE WHEN row_number() OVER (ORDER BY available DESC, stratum) <= (200 - 150) % 15 THEN 1 ELSE 0 END AS target FROM c""")
def stratum_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-3."""
    counts = table(spark, sf_dir, "orders").groupBy(F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("stratum")).agg(F.count("*").alias("available"))
    return sampling.allocate(counts, "stratum", 200, 10, 15)


@query(
    f"""WITH RECURSIVE k AS (SELECT o_orderkey AS event_id, o_orderstatus AS stratum, o_custkey AS exec, o_custkey % 50 AS company, sha256('{SEED}|calls|' || o_orderkey) AS h FROM orders),
w AS (SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS execs, CAST([] AS BIGINT[]) AS companies
      UNION ALL SELECT step + 1, list_append(taken, p.event_id), list_append(execs, p.exec), list_append(companies, p.company) FROM w, LATERAL (
        SELECT arg_min(event_id, h) AS event_id, arg_min(exec, h) AS exec, arg_min(company, h) AS company FROM k WHERE stratum = CASE WHEN w.step < 8 THEN 'F' WHEN w.step < 16 THEN 'O' ELSE 'P' END
          AND NOT list_contains(w.taken, event_id) AND len(list_filter(w.execs, lambda x: x = exec)) < 2 AND len(list_filter(w.companies, lambda x: x = company)) < 3) p WHERE step < 20)
SELECT k.event_id, stratum, exec, company FROM k JOIN (SELECT unnest(taken) AS event_id FROM w WHERE step = 20) USING (event_id)"""
)
def capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-4 over all orders; caps and targets are tested."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("stratum"), F.col("o_custkey").alias("exec"), (F.col("o_custkey") % 50).alias("company"))
    chosen = sampling.select_capped(orders, {"F": 8, "O": 8, "P": 4}, SEED, "calls", {"exec": 2, "company": 3})
    return spark.createDataFrame(chosen, "event_id long, stratum string, exec long, company long")


_BUCKETS = f"""b AS (SELECT conv_id AS event_id, conv_id || '_' || turn AS unit_id, CASE WHEN w < 50 THEN 'qa_short_lt50' WHEN w <= 200 THEN 'qa_medium_50_200' ELSE 'qa_long_gt200' END AS bucket FROM (SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM conversations)),
k AS (SELECT *, CASE bucket WHEN 'qa_short_lt50' THEN 1 WHEN 'qa_medium_50_200' THEN 2 ELSE 3 END AS o, sha256('{SEED}|fresh_evaluation_unit|' || event_id || '|' || unit_id) AS k1, sha256('{SEED}|fresh_evaluation_unit_fill|' || event_id || '|' || unit_id) AS k2 FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY event_id, bucket ORDER BY k1) = 1 AS lead FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN lead THEN o ELSE 4 END, k2) AS unit_rank FROM l)"""


@query(f"WITH {_BUCKETS} SELECT event_id, unit_id, bucket, unit_rank FROM r WHERE unit_rank <= 3")
def bucket_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-5."""
    t = table(spark, sf_dir, "conversations")
    units = t.select(F.col("conv_id").alias("event_id"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), sampling.sampling_bucket(F.lit("qa"), word_count(F.col("text"))).alias("bucket"))
    return sampling.choose_units(units, ["qa_short_lt50", "qa_medium_50_200", "qa_long_gt200"], SEED, 3)


@query("""WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), g AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM f WHERE k = 1), n AS (SELECT count(*) AS n FROM g),
p AS (SELECT s + 1 AS sample_rank, CAST(round_even(s * (n - 1) / 49.0, 0) AS BIGINT) AS i FROM n, range(50) t(s)) SELECT o_custkey, o_orderkey, CAST(sample_rank AS INTEGER) AS sample_rank FROM p JOIN g USING (i)""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-6."""
    return sampling.spread_sample(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 50)


_TIER_PART = """SELECT '{t}' AS sample_part, o_custkey, o_orderkey, CAST(s + 1 AS INTEGER) AS sample_rank FROM (SELECT count(*) AS n FROM g WHERE tier = '{t}'), range({q}) r(s) JOIN g ON tier = '{t}' AND i = CAST(round_even(s * (n - 1) / {d}, 0) AS BIGINT)"""


@query(
    """WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'review' WHEN 'O' THEN 'usable_with_flag' ELSE 'high' END AS tier FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY tier, o_custkey ORDER BY o_orderkey) AS k FROM f),
g AS (SELECT tier, o_custkey, o_orderkey, row_number() OVER (PARTITION BY tier ORDER BY o_custkey) - 1 AS i FROM k WHERE k = 1) """
    + " UNION ALL ".join(_TIER_PART.format(t=t, q=q, d=f"{q - 1}.0::DOUBLE") for t, q in (("review", 12), ("usable_with_flag", 9), ("high", 9)))
)
def tier_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-7."""
    tier = F.element_at(F.create_map(F.lit("F"), F.lit("review"), F.lit("O"), F.lit("usable_with_flag"), F.lit("P"), F.lit("high")), F.col("o_orderstatus"))
    return sampling.tier_quota_sample(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", tier.alias("tier")), "tier", "o_custkey", "o_orderkey", 30).drop("tier")


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch_id FROM orders""")
def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-9."""
    return sampling.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year_found, CASE WHEN year(o_orderdate) <= 1999 THEN '1994-1999' ELSE '2000-2005' END AS period FROM orders""")
def dates_and_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1, D-2, D-3, D-5: dates in five formats."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    formats = ["yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "ddMMMyyyy", "d-MMM-yyyy"]
    text = F.coalesce(*[F.when(k == i, F.date_format(d, f)) for i, f in enumerate(formats)])
    parsed = any_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("parsed"), quarter_text(parsed).alias("quarter"), year_in(F.concat(F.lit("call of "), F.year(d).cast("string"))).alias("year_found"), period_bin(F.year(d), 1994).alias("period"))
