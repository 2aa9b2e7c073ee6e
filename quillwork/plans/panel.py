"""Queries of the panel stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.text import company_tokens, cusip8, token_text
from quillwork.operators import census, coverage, master, tenure, turnover
from quillwork.plans import domain
from quillwork.plans.registry import ORACLES, query
from quillwork.tables import table

_SECTIONS = """se AS (SELECT conv_id AS event_id, count(*) AS total_rows, count(*) FILTER (role = 'system') AS pre_rows, count(*) FILTER (role <> 'system') AS qa_rows FROM conversations GROUP BY 1)"""


def _all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and as many ids after them that have no turn."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id")).distinct()
    return ids.unionByName(ids.select((F.col("event_id") + 1_000_000).alias("event_id")))


_CENSUS = f"""{_SECTIONS}, al AS (SELECT event_id FROM se UNION ALL SELECT event_id + 1000000 FROM se),
ce AS (SELECT event_id, coalesce(total_rows, 0) AS total_rows, coalesce(pre_rows, 0) AS pre_rows, coalesce(qa_rows, 0) AS qa_rows FROM al LEFT JOIN se USING (event_id))"""


@query(
    f"""WITH {_CENSUS}
SELECT event_id, total_rows, pre_rows, qa_rows, CAST(0 AS BIGINT) AS other_rows, CAST((pre_rows > 0)::INT + (qa_rows > 0)::INT AS BIGINT) AS kind_count,
       concat_ws(';', CASE WHEN pre_rows > 0 THEN 'PRE' END, CASE WHEN qa_rows > 0 THEN 'Q&A' END) AS kinds, pre_rows > 0 AS has_pre, qa_rows > 0 AS has_qa, pre_rows > 0 AND qa_rows > 0 AS has_both,
       pre_rows > 0 AND qa_rows = 0 AS pre_only, qa_rows > 0 AND pre_rows = 0 AS qa_only, total_rows = 0 AS no_text FROM ce"""
)
def section_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, A-4, J-1."""
    return census.census(_all_events(spark, sf_dir), domain.turns(spark, sf_dir))


@query(
    """SELECT conv_id AS event_id, count(*) FILTER (role = 'system') AS pre_ceo_rows, CAST(0 AS BIGINT) AS pre_cfo_rows, CAST(0 AS BIGINT) AS pre_analyst_rows, CAST(0 AS BIGINT) AS pre_operator_rows,
       count(*) FILTER (role = 'assistant') AS qa_ceo_rows, CAST(0 AS BIGINT) AS qa_cfo_rows, count(*) FILTER (role = 'user') AS qa_analyst_rows, CAST(0 AS BIGINT) AS qa_operator_rows FROM conversations GROUP BY 1"""
)
def section_role_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1, A-2."""
    return census.role_signals(domain.turns(spark, sf_dir), "text_name")


_FILLED = "trim(coalesce({c}, '')) <> ''"


@query(
    f"""WITH {domain.PARTICIPANTS_SQL}, co AS (SELECT event_id, count(*) AS participant_rows, count(*) FILTER ({_FILLED.format(c="participant_type")}) AS typed_rows, count(*) FILTER ({_FILLED.format(c="participant_name")}) AS named_rows,
       count(*) FILTER (participant_type = 'Chief Executive Officer') AS ceo_rows, count(*) FILTER (participant_type = 'CFO') AS cfo_rows, count(*) FILTER (participant_type = 'Analyst') AS analyst_rows,
       count(*) FILTER (participant_type = 'Operator') AS operator_rows FROM pa GROUP BY 1)
SELECT o_orderkey AS event_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("participant_rows", "typed_rows", "named_rows", "ceo_rows", "cfo_rows", "analyst_rows", "operator_rows"))} FROM orders LEFT JOIN co ON event_id = o_orderkey"""
)
def participant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3, A-4."""
    return census.participant_counts(domain.events(spark, sf_dir), domain.participants(spark, sf_dir))


@query(
    f"""WITH {domain.EVENTS_SQL}, f AS (SELECT year, event_type = 'F' AS finished, event_type = 'O' AS open FROM ev)
SELECT year, count(*) AS events, count(*) FILTER (finished) AS finished, count(*) FILTER (open) AS open, round(100.0::DOUBLE * count(*) FILTER (finished) / count(*), 2) AS finished_pct, round(100.0::DOUBLE * count(*) FILTER (open) / count(*), 2) AS open_pct FROM f GROUP BY year"""
)
def census_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-5, M-2."""
    rows = domain.events(spark, sf_dir).select("year", (F.col("event_type") == "F").alias("finished"), (F.col("event_type") == "O").alias("open"))
    return census.by_year(rows, ["finished", "open"])


@query(
    f"""WITH {domain.EVENTS_SQL} SELECT year, count(*) AS rows, count(*) FILTER (event_type = 'F') AS event_type_F, count(*) FILTER (event_type = 'O') AS event_type_O, count(*) FILTER (event_type = 'P') AS event_type_P,
       count(*) FILTER (title = '1-URGENT') AS "title_1-URGENT", count(*) FILTER (title = '2-HIGH') AS "title_2-HIGH" FROM ev GROUP BY year"""
)
def category_counts_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-6."""
    return census.category_counts(domain.events(spark, sf_dir), "year", {"event_type": ["F", "O", "P"], "title": ["1-URGENT", "2-HIGH"]})


@query("""SELECT l_returnflag || '=' || count(*) AS value_count FROM lineitem GROUP BY l_returnflag""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-7."""
    return census.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag").select(F.explode("counts")).select(F.concat_ws("=", "key", F.col("value").cast("string")).alias("value_count"))


@query(
    f"""WITH {domain.EVENTS_SQL}, s AS (SELECT CASE WHEN firm % 10 = 0 THEN 'not_selected' WHEN event_type <> 'F' THEN 'other_type' WHEN year < 1997 THEN 'before_min_year' ELSE 'eligible' END AS step FROM ev)
SELECT 0 AS step_order, 'input' AS step, count(*) AS rows FROM s UNION ALL SELECT 1, 'not_selected', count(*) FILTER (step = 'not_selected') FROM s UNION ALL SELECT 2, 'other_type', count(*) FILTER (step = 'other_type') FROM s
UNION ALL SELECT 3, 'before_min_year', count(*) FILTER (step = 'before_min_year') FROM s UNION ALL SELECT 4, 'eligible', count(*) FILTER (step = 'eligible') FROM s UNION ALL SELECT 5, 'over_limit', greatest(count(*) FILTER (step = 'eligible') - 1000, 0) FROM s"""
)
def exclusion_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13."""
    return census.waterfall(domain.events(spark, sf_dir), [("not_selected", F.col("firm") % 10 == 0), ("other_type", F.col("event_type") != "F"), ("before_min_year", F.col("year") < 1997)], limit=1000)


@query(f"""WITH {domain.EVENTS_SQL} SELECT event_id, start_date, firm FROM ev WHERE event_type = 'F' AND year >= 1996 ORDER BY start_date, event_id LIMIT 100""")
def limit_after_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, L-1."""
    return census.metadata(domain.events(spark, sf_dir), "F", 1996, 100).select("event_id", "start_date", "firm")


@query(f"""WITH {domain.EVENTS_SQL} SELECT event_id, start_date FROM ev WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) ORDER BY start_date, event_id LIMIT 500""")
def events_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-12."""
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("event_id"))
    return census.select_ids(domain.events(spark, sf_dir), ids, 500).select("event_id", "start_date")


@query(
    f"""WITH {_CENSUS}
SELECT event_id, CASE WHEN pre_rows > 0 AND qa_rows > 0 THEN 'raw_both_pre_and_qa' WHEN pre_rows > 0 THEN 'raw_pre_only' WHEN qa_rows > 0 THEN 'raw_qa_only' WHEN total_rows = 0 THEN 'raw_no_text' ELSE 'other_or_unusual_text_type' END AS section_status,
       CASE WHEN pre_rows > 0 AND qa_rows > 0 THEN 'candidate_raw_sections' WHEN pre_rows > 0 THEN 'needs_hidden_qna_repair_probe' WHEN qa_rows > 0 THEN 'exclude_no_presentation' WHEN total_rows = 0 THEN 'exclude_no_text' ELSE 'review_section_type' END AS difference_status,
       CASE WHEN pre_rows > 0 AND qa_rows = 0 THEN CASE WHEN pre_rows >= 3 THEN 'high' ELSE 'medium' END ELSE 'none' END AS repair_priority FROM ce"""
)
def section_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-1."""
    rows = census.census(_all_events(spark, sf_dir), domain.turns(spark, sf_dir))
    return rows.select("event_id", master.section_ladder(F.col("pre_rows"), F.col("qa_rows"), F.col("total_rows")).alias("s")).select("event_id", "s.section_status", "s.difference_status", "s.repair_priority")


@query(
    r"""WITH c AS (SELECT p_partkey AS event_id, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS isin, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS company_id,
       list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('a','ab','ag','and','asa','bhd','bm','co','company','corp','corporation','gmbh','group','holdings','inc','incorporated','kk','limited','llc','ltd','nv','oyj','plc','sa','se','spa','the')) AS tokens,
       string_split(trim(regexp_replace(lower(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END), '[^a-z0-9]+', ' ', 'g')), ' ') AS title FROM part),
f AS (SELECT *, isin <> '' AS sec, ticker <> '' AS ext, company_id <> '' AS int_, len(tokens) > 0 AND len(list_intersect(tokens, title)) = 0 AS bad FROM c)
SELECT event_id, CASE WHEN sec THEN 'security_identifier_plus_event_date' WHEN ext THEN 'ticker_plus_event_date_plus_historical_name_review' WHEN int_ THEN 'ccts_company_id_bridge_required' ELSE 'manual_name_date_review_required' END AS match_key, bad AS name_conflict,
       CASE WHEN bad THEN CASE WHEN sec THEN 'review_title_name_conflict_identifier_backed' WHEN ext THEN 'review_title_name_conflict_external_id_limited' WHEN int_ THEN 'high_risk_title_name_conflict_internal_id_only' ELSE 'high_risk_title_name_conflict_no_identifier' END
            ELSE CASE WHEN sec THEN 'ok_identifier_backed' WHEN ext THEN 'ok_external_id_limited' WHEN int_ THEN 'review_internal_id_only' ELSE 'review_missing_identifier' END END AS status,
       CASE WHEN bad THEN CASE WHEN sec THEN 'medium' WHEN ext THEN 'medium_high' ELSE 'high' END ELSE CASE WHEN sec THEN 'low' WHEN ext THEN 'medium_low' WHEN int_ THEN 'medium_high' ELSE 'high' END END AS risk FROM f"""
)
def firm_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-2, T-3, T-4, T-22, O-6."""
    k = F.col("p_partkey")
    given = lambda n, c: F.when(k % n == 0, c).otherwise("")
    present = master.identifiers({"isin": given(4, F.col("p_brand")), "ticker": given(3, F.col("p_type")), "company_id": given(2, F.lit("x"))})
    title = F.split(token_text(F.when(k % 5 == 0, F.col("p_type")).otherwise(F.col("p_name"))), " ")
    out = table(spark, sf_dir, "part").select(k.alias("event_id"), present.alias("present"), company_tokens(F.col("p_name")).alias("tokens"), title.alias("title"))
    return out.select("event_id", master.firm_ladder(F.col("present"), F.col("tokens"), F.col("title")).alias("f")).select("event_id", "f.match_key", "f.name_conflict", "f.status", "f.risk")


@query(
    f"""WITH {domain.PARTICIPANTS_SQL}, co AS (SELECT event_id, count(*) AS n, count(*) FILTER (participant_type = 'Chief Executive Officer') AS ceo FROM pa GROUP BY 1)
SELECT o_orderkey AS event_id, CASE WHEN coalesce(ceo, 0) > 0 THEN 'participant_ceo_signal_available' WHEN coalesce(n, 0) > 0 THEN 'participants_available_no_ceo_signal' ELSE 'no_participant_rows' END AS manager_layer_status FROM orders LEFT JOIN co ON event_id = o_orderkey"""
)
def manager_layer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-3."""
    rows = census.participant_counts(domain.events(spark, sf_dir), domain.participants(spark, sf_dir))
    return rows.select("event_id", master.manager_layer(F.col("ceo_rows"), F.col("participant_rows")).alias("manager_layer_status"))


_ISLANDS = f"""{domain.ROSTER_SQL}, i AS (SELECT *, sum(fresh) OVER (PARTITION BY gvkey, execid ORDER BY year) AS tenure_episode FROM (SELECT *, CASE WHEN lag(year) OVER w IS NULL OR year > lag(year) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM ro WINDOW w AS (PARTITION BY gvkey, execid ORDER BY year)))"""

_DATED = f"""{_ISLANDS}, g AS (SELECT gvkey, execid, CAST(tenure_episode AS INTEGER) AS tenure_episode, min(year) AS first_year, max(year) AS last_year, count(*) AS annual_rows,
       max(CASE WHEN becameceo <> '' THEN CAST(becameceo AS DATE) END) AS s, max(CASE WHEN leftofc <> '' THEN CAST(strptime(leftofc, '%m/%d/%Y') AS DATE) END) AS e FROM i GROUP BY 1, 2, 3),
k AS (SELECT *, coalesce(year(s) > last_year + 1, false) OR (tenure_episode > 1 AND coalesce(year(s) < first_year - 1, false)) OR coalesce(year(e) < first_year - 1, false) AS bad FROM g),
d AS (SELECT gvkey, execid, tenure_episode, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, annual_rows,
       CASE WHEN NOT bad AND s IS NOT NULL THEN s ELSE make_date(first_year, 1, 1) END AS start_date, CASE WHEN NOT bad AND e IS NOT NULL THEN e ELSE make_date(last_year, 12, 31) END AS end_date,
       CASE WHEN bad THEN '{tenure.CONFLICT}' WHEN s IS NOT NULL THEN '{tenure.START_EXACT}' ELSE '{tenure.START_BOUND}' END AS start_date_source,
       CASE WHEN bad THEN '{tenure.CONFLICT}' WHEN e IS NOT NULL THEN '{tenure.END_EXACT}' ELSE '{tenure.END_BOUND}' END AS end_date_source FROM k),
n AS (SELECT *, lead(first_year) OVER w AS nf, lead(start_date) OVER w AS ns, lead(start_date_source) OVER w AS nx FROM d WINDOW w AS (PARTITION BY gvkey ORDER BY first_year, start_date, execid, tenure_episode)),
t AS (SELECT *, end_date_source = '{tenure.END_BOUND}' AND coalesce(nx = '{tenure.START_EXACT}' AND nf <= last_year + 1 AND ns >= start_date, false) AS take FROM n)"""


@query(f"WITH {_ISLANDS} SELECT gvkey, execid, CAST(tenure_episode AS INTEGER) AS tenure_episode, min(year) AS first_year, max(year) AS last_year, count(*) AS annual_rows FROM i GROUP BY 1, 2, 3")
def tenure_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-3."""
    rows = tenure.islands(domain.roster(spark, sf_dir), ["gvkey", "execid"])
    return rows.groupBy("gvkey", "execid", "tenure_episode").agg(F.min("year").cast("long").alias("first_year"), F.max("year").cast("long").alias("last_year"), F.count("*").alias("annual_rows"))


@query(
    f"""WITH {_DATED} SELECT gvkey, execid, tenure_episode, first_year, last_year, annual_rows, start_date, CASE WHEN take THEN ns ELSE end_date END AS end_date, start_date_source,
       CASE WHEN take THEN '{tenure.END_NEXT}' ELSE end_date_source END AS end_date_source, CASE WHEN start_date_source = '{tenure.CONFLICT}' THEN 'source_boundary_conflict_review'
       WHEN start_date > CASE WHEN take THEN ns ELSE end_date END THEN 'invalid_date_order_review' WHEN start_date_source = '{tenure.START_EXACT}' AND (take OR end_date_source = '{tenure.END_EXACT}') THEN '{tenure.EXACT}' ELSE 'annual_flag_date_bounds' END AS normalization_status FROM t"""
)
def tenure_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-3, W-4, A-27, D-2, D-6, D-7."""
    return tenure.episodes(domain.roster(spark, sf_dir))


@query(f"WITH {_DATED} SELECT gvkey, execid, tenure_episode, end_date AS annual_end, ns AS end_date FROM t WHERE take")
def tenure_end_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-4: the ends that the next episode's start replaces."""
    found = tenure.episodes(domain.roster(spark, sf_dir)).filter(F.col("end_date_source") == tenure.END_NEXT)
    return found.select("gvkey", "execid", "tenure_episode", F.make_date("last_year", F.lit(12), F.lit(31)).alias("annual_end"), "end_date")


_COVER = f"""{domain.TENURES_SQL}, {domain.CALLS_SQL}, j AS (SELECT ca.event_id, ca.event_date, ca.key, te.key AS k2, te.gvkey, te.execid, te.normalization_status AS st, event_date BETWEEN start_date AND end_date AS cov FROM ca LEFT JOIN te ON ca.key = te.key AND ca.key <> ''),
g AS (SELECT event_id, event_date, key, count(k2) AS cands, count(DISTINCT gvkey) AS gv, count(*) FILTER (gvkey = '') AS blank, min(gvkey) AS any_gv, count(*) FILTER (cov) AS covering, min(execid) FILTER (cov) AS ex, min(st) FILTER (cov) AS st FROM j GROUP BY 1, 2, 3),
i AS (SELECT *, CASE WHEN key = '' THEN 'no_ccts_cusip' WHEN cands = 0 THEN 'no_execucomp_cusip8_match' WHEN blank > 0 THEN 'review_missing_execucomp_gvkey' WHEN gv = 1 THEN 'exact_cusip8_single_gvkey' ELSE 'ambiguous_cusip8_multiple_gvkeys' END AS issuer_match_status FROM g),
v AS (SELECT *, CASE WHEN cands = 0 THEN 'not_testable_no_issuer_match' WHEN issuer_match_status <> 'exact_cusip8_single_gvkey' THEN 'review_ambiguous_issuer_match' WHEN covering = 0 THEN 'issuer_match_no_ceo_date_coverage' WHEN covering > 1 THEN 'review_multiple_ceos_cover_event'
       WHEN st = 'exact_tenure_dates' THEN 'covered_exact_ceo_tenure' ELSE 'covered_review_ceo_tenure' END AS ceo_coverage_status FROM i)"""


@query(
    f"""WITH {_COVER} SELECT event_id, event_date, key, issuer_match_status, CASE WHEN issuer_match_status = 'exact_cusip8_single_gvkey' THEN any_gv END AS gvkey, ceo_coverage_status, covering AS ceo_candidate_count, CASE WHEN covering = 1 THEN ex END AS execid,
       CASE WHEN covering = 1 THEN st END AS normalization_status, CASE ceo_coverage_status WHEN 'covered_exact_ceo_tenure' THEN 'high' WHEN 'covered_review_ceo_tenure' THEN 'medium' WHEN 'review_ambiguous_issuer_match' THEN 'review' WHEN 'review_multiple_ceos_cover_event' THEN 'review' ELSE 'unmatched' END AS match_confidence FROM v"""
)
def coverage_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-2, C-4."""
    return coverage.cover(domain.calls(spark, sf_dir), domain.tenures(spark, sf_dir)).drop("tenure_episode", "start_date", "end_date")


@query(
    f"""WITH {_COVER} SELECT year(event_date)::INT AS year, count(*) AS calls, count(*) FILTER (ceo_coverage_status = 'covered_exact_ceo_tenure') AS covered_exact, count(*) FILTER (ceo_coverage_status = 'covered_review_ceo_tenure') AS covered_review,
       count(*) FILTER (ceo_coverage_status LIKE 'covered_%') AS covered_any, round(100.0::DOUBLE * count(*) FILTER (ceo_coverage_status LIKE 'covered_%') / count(*), 4) AS covered_any_pct FROM v GROUP BY 1"""
)
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-8."""
    return coverage.by_year(coverage.cover(domain.calls(spark, sf_dir), domain.tenures(spark, sf_dir)))


@query(
    f"""WITH {_COVER} SELECT count(*) AS calls, count(DISTINCT any_gv) FILTER (issuer_match_status = 'exact_cusip8_single_gvkey') AS firms, count(DISTINCT ex) FILTER (covering = 1) AS episodes, count(DISTINCT key) FILTER (key <> '') AS cusips, min(event_date) AS first_date, max(event_date) AS last_date FROM v"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-9."""
    covered = coverage.cover(domain.calls(spark, sf_dir), domain.tenures(spark, sf_dir))
    return coverage.summary(covered)


@query(f"WITH {_COVER} SELECT event_id, any_gv AS gvkey, ex AS execid FROM v WHERE ceo_coverage_status = 'covered_exact_ceo_tenure' AND covering = 1 AND any_gv <> ''")
def exact_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-8."""
    return coverage.exact_panel(coverage.cover(domain.calls(spark, sf_dir), domain.tenures(spark, sf_dir))).select("event_id", "gvkey", "execid")


@query("""SELECT p_partkey, CASE WHEN length(regexp_replace(upper(p_brand || p_type), '[^A-Z0-9]', '', 'g')) >= 8 THEN substr(regexp_replace(upper(p_brand || p_type), '[^A-Z0-9]', '', 'g'), 1, 8) ELSE '' END AS cusip8 FROM part""")
def cusip8_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-21."""
    return table(spark, sf_dir, "part").select("p_partkey", cusip8(F.concat("p_brand", "p_type")).alias("cusip8"))


_QUARTER = "year(event_date)::VARCHAR || 'Q' || quarter(event_date)::VARCHAR"


@query(
    f"""WITH {domain.PANEL_SQL}, q AS (SELECT *, {_QUARTER} AS cq FROM pn), s AS (SELECT gvkey, execid, tenure_episode, count(*) AS n, count(DISTINCT cq) AS nq FROM q GROUP BY 1, 2, 3)
SELECT gvkey, execid, tenure_episode, event_id, event_date, cq AS calendar_quarter, row_number() OVER w AS call_index_in_episode, n AS calls_in_episode, nq AS distinct_quarters_in_episode, event_date - start_date AS days_since_ceo_start, end_date - event_date AS days_until_ceo_end,
       event_date - lag(event_date) OVER w AS days_from_previous_call, lead(event_date) OVER w - event_date AS days_to_next_call, n >= 5 AS has_at_least_5_calls, nq >= 5 AS has_at_least_5_distinct_quarters
FROM q JOIN s USING (gvkey, execid, tenure_episode) WINDOW w AS (PARTITION BY gvkey, execid, tenure_episode ORDER BY event_date, CAST(event_id AS VARCHAR))"""
)
def call_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1, W-2, A-10, D-1, D-4."""
    return turnover.call_sequences(domain.panel(spark, sf_dir))


_TURNOVERS = f"""{domain.PANEL_SQL}, c AS (SELECT gvkey AS g, execid AS x, count(*) AS n, count(DISTINCT {_QUARTER}) AS q, min(event_date) AS f, max(event_date) AS l, arg_min(event_id, (event_date, CAST(event_id AS VARCHAR))) AS fi, arg_max(event_id, (event_date, CAST(event_id AS VARCHAR))) AS li FROM pn GROUP BY 1, 2),
p AS (SELECT gvkey, execid AS old_execid, start_date AS os, end_date AS oe, normalization_status AS ost, lead(execid) OVER w AS new_execid, lead(start_date) OVER w AS ns, lead(normalization_status) OVER w AS nst FROM tn WINDOW w AS (PARTITION BY gvkey ORDER BY start_date, end_date, CAST(execid AS VARCHAR))),
r AS (SELECT 'execucomp_turnover_' || lpad(CAST(row_number() OVER (ORDER BY gvkey, os, oe) AS VARCHAR), 5, '0') AS turnover_id, p.*, ns - oe AS gap, coalesce(a.n, 0) AS old_calls, coalesce(a.q, 0) AS oq, a.li AS old_last, a.l AS ol, coalesce(b.n, 0) AS new_calls, coalesce(b.q, 0) AS nq, b.fi AS new_first, b.f AS nf
      FROM p LEFT JOIN c a ON a.g = gvkey AND a.x = old_execid LEFT JOIN c b ON b.g = gvkey AND b.x = new_execid WHERE new_execid IS NOT NULL AND new_execid <> old_execid),
o AS (SELECT *, CASE WHEN ost <> 'exact_tenure_dates' OR nst <> 'exact_tenure_dates' THEN 'review_nonexact_adjacent_tenure' WHEN gap < 0 THEN 'review_overlapping_exact_tenures' ELSE 'exact_adjacent_ceo_change' END AS roster_transition_status,
      nf - ol AS call_gap_days, coalesce(nf - ol BETWEEN 0 AND 120, false) AS near FROM r),
z AS (SELECT *, CASE WHEN roster_transition_status <> 'exact_adjacent_ceo_change' THEN roster_transition_status WHEN old_calls = 0 AND new_calls = 0 THEN 'exact_turnover_no_calls_either_side' WHEN old_calls = 0 THEN 'exact_turnover_no_old_ceo_call' WHEN new_calls = 0 THEN 'exact_turnover_no_new_ceo_call'
      WHEN NOT near THEN 'exact_turnover_call_gap_exceeds_120_days' WHEN oq < 5 OR nq < 5 THEN 'exact_turnover_within_120_insufficient_5q_each_side' ELSE 'anchor_turnover_ready' END AS turnover_window_status FROM o)"""


@query(
    f"""WITH {_TURNOVERS} SELECT turnover_id, gvkey, old_execid, new_execid, gap AS roster_transition_gap_days, roster_transition_status, old_calls, oq AS old_distinct_quarters, new_calls, nq AS new_distinct_quarters, old_last AS old_last_event_id, new_first AS new_first_event_id,
       call_gap_days, turnover_window_status, turnover_window_status = 'anchor_turnover_ready' AS anchor_turnover_ready FROM z"""
)
def turnover_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4, J-5, W-5, W-6, C-5."""
    rows = turnover.turnovers(domain.firm_tenures(spark, sf_dir), domain.panel(spark, sf_dir))
    return rows.select("turnover_id", "gvkey", "old_execid", "new_execid", "roster_transition_gap_days", "roster_transition_status", "old_calls", "old_distinct_quarters", "new_calls", "new_distinct_quarters", "old_last_event_id", "new_first_event_id", "call_gap_days", "turnover_window_status", "anchor_turnover_ready")


_SIDES = f"""{_TURNOVERS}, s AS (SELECT turnover_id, gvkey, 'old_episode' AS side, old_execid AS execid, old_calls AS pair_calls FROM z WHERE turnover_window_status = 'anchor_turnover_ready' UNION ALL SELECT turnover_id, gvkey, 'new_episode', new_execid, new_calls FROM z WHERE turnover_window_status = 'anchor_turnover_ready'),
e AS (SELECT gvkey, execid, string_agg(DISTINCT turnover_id, ';' ORDER BY turnover_id) AS turnover_ids, string_agg(DISTINCT side, ';' ORDER BY side) AS roles, max(pair_calls) AS pair_calls FROM s GROUP BY 1, 2)"""


def _ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = domain.panel(spark, sf_dir)
    return turnover.turnovers(domain.firm_tenures(spark, sf_dir), panel).filter("anchor_turnover_ready"), turnover.call_sequences(panel)


@query(f"""WITH {_SIDES} SELECT e.gvkey, e.execid, turnover_ids, roles, pair_calls, coalesce(n, 0) AS calls, coalesce(q, 0) AS quarters, coalesce(n, 0) = pair_calls AS counts_agree FROM e LEFT JOIN c ON g = e.gvkey AND x = e.execid""")
def candidate_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-6, A-11."""
    return turnover.candidate_episodes(*_ready(spark, sf_dir)).drop("tenure_episode")


@query(f"""WITH {_SIDES} SELECT gvkey, execid, event_id, event_date, {_QUARTER} AS calendar_quarter, turnover_ids FROM pn JOIN e USING (gvkey, execid)""")
def candidate_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-6, J-7."""
    return turnover.candidate_assignments(*_ready(spark, sf_dir)).drop("tenure_episode")


@query(f"""WITH {domain.PANEL_SQL} SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'date_outside_tenure' WHEN 1 THEN 'boundary_changed' WHEN 2 THEN 'duplicate_call' ELSE 'no_roster_row' END AS violations FROM pn WHERE event_id % 7 < 4""")
def panel_roster_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3: calls that are moved out of their tenure, with another end, twice, or of a person without tenure."""
    k, panel = F.col("event_id") % 7, domain.panel(spark, sf_dir)
    broken = panel.withColumns({
        "event_date": F.when(k == 0, F.add_months("event_date", 600)).otherwise(F.col("event_date")), "end_date": F.when(k == 1, F.date_add("end_date", 1)).otherwise(F.col("end_date")),
        "execid": F.when(k == 3, F.lit(-1).cast("long")).otherwise(F.col("execid")),
    })
    return turnover.panel_violations(broken.unionByName(broken.filter(k == 2)), domain.firm_tenures(spark, sf_dir))


@query(
    f"""WITH RECURSIVE t AS (SELECT turnover_id, gvkey, turnover_window_status FROM ({ORACLES["turnover_windows"]})), c AS (SELECT list(s ORDER BY s) AS names, list(n ORDER BY s) AS ns FROM (SELECT turnover_window_status AS s, count(*) AS n FROM t GROUP BY 1)),
w AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS picks, names AS lf FROM c
      UNION ALL SELECT step + 1, p, list_filter(names, lambda x: len(list_filter(p, lambda y: y = x)) < ns[list_position(names, x)]) FROM (SELECT step, list_append(picks, lf[step % len(lf) + 1]) AS p FROM w WHERE step < 40 AND len(lf) > 0), c),
l AS (SELECT unnest(picks) AS s, unnest(range(1, len(picks) + 1)) AS audit_rank FROM (SELECT picks FROM w ORDER BY step DESC LIMIT 1)), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY audit_rank) AS k FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY turnover_window_status ORDER BY gvkey, turnover_id) AS k FROM t)
SELECT audit_rank, turnover_window_status, turnover_id FROM k JOIN r ON k.k = r.k AND s = turnover_window_status"""
)
def round_robin_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-8."""
    rows = turnover.turnovers(domain.firm_tenures(spark, sf_dir), domain.panel(spark, sf_dir))
    return turnover.round_robin(rows, "turnover_window_status", ["gvkey", "turnover_id"], 40).select("audit_rank", "turnover_window_status", "turnover_id")
