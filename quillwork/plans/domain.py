"""The driver's tables as the domain's: events, participants, rosters, calls, turns, units, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.text import clean, word_count
from quillwork.tables import spread, table

# Speaker labels that stand for the roles of conversations: an executive who speaks in both sections, and questioners.
EXECUTIVE = "Jane Roe, Acme - Chief Executive Officer"
QUESTIONER = "John Doe, Big Bank, Research Division - Analyst"

EVENTS_SQL = "ev AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS start_date, year(o_orderdate) AS year, o_custkey AS firm, o_orderstatus AS event_type, o_orderpriority AS title FROM orders)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("start_date"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("firm"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("title"))


PARTICIPANTS_SQL = """pa AS (SELECT l_orderkey AS event_id, CASE l_linenumber WHEN 1 THEN 'Analyst' WHEN 2 THEN 'Chief Executive Officer' WHEN 3 THEN 'Operator' WHEN 4 THEN 'CFO' ELSE '' END AS participant_type,
                              CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS participant_name FROM lineitem)"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "Analyst").when(n == 2, "Chief Executive Officer").when(n == 3, "Operator").when(n == 4, "CFO").otherwise("")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), kind.alias("participant_type"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("participant_name"))


ROSTER_SQL = """ro AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS gvkey, o_custkey AS execid, year(o_orderdate) AS year,
       CASE WHEN o_custkey % 2 = 0 THEN strftime(min(o_orderdate) OVER (PARTITION BY o_custkey), '%Y-%m-%d') ELSE '' END AS becameceo,
       CASE WHEN o_custkey % 3 = 0 THEN strftime(max(o_orderdate) OVER (PARTITION BY o_custkey), '%m/%d/%Y') ELSE '' END AS leftofc
       FROM orders JOIN customer ON c_custkey = o_custkey)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual rows: a firm is a nation, a person a customer; some have a first and some a last day."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    days = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    years = orders.select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    key = F.col("o_custkey")
    joined = years.join(days, "o_custkey").join(customer, F.col("c_custkey") == key)
    return joined.select(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("gvkey"), key.alias("execid"), "year", F.when(key % 2 == 0, F.date_format("first", "yyyy-MM-dd")).otherwise("").alias("becameceo"),
        F.when(key % 3 == 0, F.date_format("last", "MM/dd/yyyy")).otherwise("").alias("leftofc"),
    )


# Four customers share a key and eight a firm, but for some with another firm or none.
TENURES_SQL = """te AS (SELECT 'K' || lpad(CAST(c_custkey // 4 AS VARCHAR), 8, '0') AS key, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'other' ELSE lpad(CAST(c_custkey // 8 AS VARCHAR), 8, '0') END AS gvkey, c_custkey AS execid, 1 AS tenure_episode,
       make_date(1995 + 2 * CAST(c_custkey % 4 AS INTEGER), 1, 1) AS start_date, make_date(1997 + 2 * CAST(c_custkey % 4 AS INTEGER) - CAST(c_custkey % 3 AS INTEGER) + 1, 6, 30) AS end_date,
       CASE WHEN c_custkey % 5 = 0 THEN 'annual_flag_date_bounds' ELSE 'exact_tenure_dates' END AS normalization_status FROM customer)"""


def tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenure of each customer: those of a key follow one another, with gaps and overlaps."""
    k = F.col("c_custkey")
    pad = lambda n: F.lpad(F.floor(k / n).cast("string"), 8, "0")
    begin = 1995 + 2 * (k % 4)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("K"), pad(4)).alias("key"), F.when(k % 11 == 0, "").when(k % 7 == 0, "other").otherwise(pad(8)).alias("gvkey"), k.alias("execid"), F.lit(1).alias("tenure_episode"),
        F.make_date(begin.cast("int"), F.lit(1), F.lit(1)).alias("start_date"), F.make_date((begin + 3 - k % 3).cast("int"), F.lit(6), F.lit(30)).alias("end_date"),
        F.when(k % 5 == 0, "annual_flag_date_bounds").otherwise("exact_tenure_dates").alias("normalization_status"),
    )


CALLS_SQL = "ca AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'none' ELSE 'K' || lpad(CAST(o_custkey // 4 AS VARCHAR), 8, '0') END AS key FROM orders)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key = F.when(k % 13 == 0, "").when(k % 17 == 0, "none").otherwise(F.concat(F.lit("K"), F.lpad(F.floor(F.col("o_custkey") / 4).cast("string"), 8, "0")))
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), F.to_date("o_orderdate").alias("event_date"), key.alias("key"))


# Adjacent exact tenures: a firm is a nation, a person the customers of a residue, one after another every 15 months.
PANEL_SQL = """tn AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS gvkey, CAST(c_custkey % 5 AS BIGINT) AS execid, 1 AS tenure_episode,
       CAST(make_date(1995, 1, 1) + INTERVAL 1 MONTH * (15 * CAST(c_custkey % 5 AS INTEGER)) AS DATE) AS start_date, CAST(make_date(1995, 1, 1) + INTERVAL 1 MONTH * (15 * CAST(c_custkey % 5 AS INTEGER) + 15) AS DATE) AS end_date,
       CASE WHEN c_custkey % 5 = 4 THEN 'annual_flag_date_bounds' ELSE 'exact_tenure_dates' END AS normalization_status FROM customer),
pn AS (SELECT tn.*, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN tn ON tn.gvkey = lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AND tn.execid = c_custkey % 5 WHERE CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date AND normalization_status = 'exact_tenure_dates')"""


def firm_tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    month = lambda n: F.add_months(F.make_date(F.lit(1995), F.lit(1), F.lit(1)), n.cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("gvkey"), k.alias("execid"), F.lit(1).alias("tenure_episode"), month(15 * k).alias("start_date"), month(15 * k + 15).alias("end_date"),
        F.when(k == 4, "annual_flag_date_bounds").otherwise("exact_tenure_dates").alias("normalization_status"),
    ).distinct()


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of each exact tenure."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    whose = customer.select("c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("gvkey"), (F.col("c_custkey") % 5).alias("execid"))
    of = orders.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_custkey").alias("c_custkey")).join(whose, "c_custkey").drop("c_custkey")
    return of.join(firm_tenures(spark, sf_dir), ["gvkey", "execid"]).filter("event_date between start_date and end_date and normalization_status = 'exact_tenure_dates'")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sequence_id, section (PRE or Q&A), role, text_name, text_contents from conversations."""
    section = F.when(F.col("role") == "system", "PRE").otherwise("Q&A")
    name = F.when(F.col("role") == "user", QUESTIONER).otherwise(EXECUTIVE)
    return spread(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("event_id"), F.col("turn").alias("sequence_id"), section.alias("section"), "role", name.alias("text_name"), F.col("text").alias("text_contents"))


UNITS_SQL = r"""un AS (SELECT conv_id AS event_id, turn AS sequence_id, CASE WHEN role = 'system' THEN 'PRE' ELSE 'Q&A' END AS section, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations WHERE role <> 'user'),
u AS (SELECT event_id, sequence_id, section, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words, CASE WHEN t = '' THEN NULL ELSE 1 + length(t) % 5 END AS score FROM un)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executive turns with their words and a stub score."""
    text = clean(F.col("text_contents"))
    score: Column = F.when(text != "", 1 + F.length(text) % 5)
    return turns(spark, sf_dir).filter("role <> 'user'").select("event_id", "sequence_id", "section", word_count(F.col("text_contents")).alias("words"), score.alias("score"))


RATERS_SQL = r"""ra AS (SELECT doc_id, n_chars % 5 + 1 AS human, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 3 = 0 THEN n_chars % 5 + 1 ELSE length(text) // 3 % 5 + 1 END AS model FROM documents)"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores from 1 to 5 for each document; the second is missing for some."""
    n = F.col("n_chars")
    model = F.when(n % 7 == 0, None).when(n % 3 == 0, n % 5 + 1).otherwise(F.floor(F.length("text") / 3) % 5 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", (n % 5 + 1).alias("human"), model.cast("long").alias("model"))
