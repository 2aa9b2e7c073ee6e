"""Queries of sources, publication, checkpoints, packets and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import roles, stats
from quillwork.functions.text import duration_text, person_name, text_set
from quillwork.operators import contracts, episodes, gate, scoring
from quillwork.plans import attribution, domain
from quillwork.plans.registry import query
from quillwork.sources import publish, strict
from quillwork.storage import new_path, written
from quillwork.streaming import resume
from quillwork.tables import table

_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def _through_csv(df: DataFrame, **options: str) -> DataFrame:
    """A table written as gzipped CSV with quoted fields, and read strictly."""
    path = new_path(df.sparkSession, "csv")
    df.write.options(header=True, compression="gzip", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return strict.read_csv(df.sparkSession, path, exact=df.columns, **options)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5 to SRC-8, K-3: texts with line breaks and quotes through gzipped CSV."""
    back = _through_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), required=["doc_id"])
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, {_CLEAN.format(c='role')} AS role, sha256(coalesce(text, '')) AS text_sha256, {_CLEAN.format(c='text')} AS cleaned FROM conversations")
def cleaned_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-1, K-2: cells with white space collapsed, but for a column whose line breaks mean something."""
    rows = table(spark, sf_dir, "conversations").withColumn("cleaned", F.col("text"))
    back = _through_csv(publish.clean_cells(rows.select("conv_id", "turn", "role", "text", "cleaned"), keep=("text",)))
    return back.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "cleaned")


@query("SELECT c_custkey AS execid, c_name AS name, 'customer' AS layout FROM customer")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9, SRC-15: columns by alias whatever their case, and the layout that a header is."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ExecID"), F.col("c_name").alias("Full_Name"), F.lit("x").alias("name"))
    found = strict.select_aliases(df, {"execid": ["execid", "co_per_rol"], "name": ["full_name", "name"]}, ["execid"])
    kind = strict.layout(df.columns, {"customer": ["ExecID", "Full_Name", "name"], "other": ["execid"]})
    return found.withColumn("layout", F.lit(kind))


@query("SELECT o_orderkey, o_custkey, 2 AS version FROM orders WHERE o_orderkey % 2 = 0")
def published_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-4, K-5, K-8, R-1, R-2, R-5, R-14: two publications, verified against their receipts; the latest is read."""
    root, rows = new_path(spark, "published"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    for version in (1, 2):
        part = rows if version == 1 else rows.filter("o_orderkey % 2 = 0")
        told = publish.publish(part.withColumn("version", F.lit(version)), f"{root}/v{version}", receipt={"version": version})
        contracts.require_empty(part.agg(F.count("*").alias("n")).filter(F.col("n") != told["rows"]), "rows differ from the receipt")
        publish.point_latest(spark, root, f"v{version}")
    return spark.read.parquet(publish.latest(spark, root))


@query("SELECT user_id AS event_id, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def census_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-6, R-4, R-6, R-16: counts in committed batches, begun by one run and resumed by another; no row is a measured 0."""
    events = table(spark, sf_dir, "events")
    batches = events.select(F.col("user_id").alias("event_id")).distinct().withColumn("batch_id", F.col("event_id") % 4)

    def work(ids: DataFrame) -> DataFrame:
        clicks = events.filter("event_type = 'click'").select(F.col("user_id").alias("event_id"))
        return clicks.join(ids, "event_id").groupBy("event_id").agg(F.count("*").alias("clicks"))

    root = new_path(spark, "batches")
    resume.BatchStore(spark, root, {"query": "clicks", "version": 1}).run(batches.filter("batch_id < 2"), work)
    store = resume.BatchStore(spark, root, {"version": 1, "query": "clicks"})
    store.run(batches, work)
    return store.materialise(batches)


@query("SELECT CAST(user_id AS VARCHAR) AS custom_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 2")
def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-9, R-8: a stream of results into an append-only log, two for each id."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("custom_id"), "event_id", F.col("event_type").alias("status"))
    source = written(rows, "results")
    root = new_path(spark, "result-log")
    resume.append_results(spark.readStream.schema(rows.schema).parquet(source._quillwork_path), f"{root}/log", f"{root}/state").awaitTermination()
    return resume.read_results(spark, f"{root}/log").select(*rows.columns)


@query("SELECT substr(sha256('packet|' || doc_id), 1, 16) AS audit_id, n_chars FROM documents")
def blinded_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10, K-13: the public half of a blinded table, whose header is guarded."""
    public, private = publish.split_blinded(table(spark, sf_dir, "documents"), ["n_chars"], ["source"], "doc_id", "packet")
    strict.guard_header(public.columns, ["audit_id", "n_chars"], [c for c in private.columns if c != "audit_id"])
    return public


@query("""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT 5 + row_number() OVER (ORDER BY s) AS line, '| ' || s || ' | ' || n || ' |' AS text FROM c)
SELECT 0 AS line, '# Orders' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## status' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| status | orders |' UNION ALL SELECT 5, '| --- | --- |' UNION ALL SELECT line, text FROM r""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11, K-12: the lines of a Markdown report of counts."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders")).orderBy("status")
    text = publish.report("Orders", {"status": counts}).rstrip("\n")
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), "\n")).alias("line", "text"))


_LABELS = [
    ("Jane Roe, Acme - Chief Executive Officer", True, False, False, False), ("Jane Roe, Acme - Former CEO", False, False, False, False), ("Jane Roe, Acme - Interim CEO", True, True, False, False),
    ("John Doe, Big Bank, Research Division - Analyst", False, False, True, False), ("Operator", False, False, False, True), ("Analyst", False, False, True, False),
    ("John Doe, Big Bank, Research Division - Managing Director", False, False, True, False), ("Mary Poe, Acme - Investor Relations Analyst", False, False, False, False),
    ("Ann Lee, Acme - CEO Assistant", False, False, False, False), ("Bob Kim, Other Firm - Analyst", False, False, False, False), ("Ed Fox, Acme - Acting CFO", False, False, False, False),
]


@query(f"""WITH l(k, ceo, special, analyst, operator) AS (VALUES {", ".join(f"({k}, {', '.join(str(x).lower() for x in r[1:])})" for k, r in enumerate(_LABELS))})
SELECT s_suppkey, ceo, special, analyst, operator, operator AND s_suppkey % 2 = 0 AS next_question, s_suppkey % {len(_LABELS)} IN (0, 1, 2, 8) AS ceo_signal, s_suppkey % {len(_LABELS)} IN (3, 5, 7, 9) AS analyst_signal FROM supplier JOIN l ON k = s_suppkey % {len(_LABELS)}""")
def speaker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-2 to P-6: eleven kinds of labels; one is of an issuer's firm."""
    k = F.col("s_suppkey")
    name = F.get(F.array(*[F.lit(r[0]) for r in _LABELS]), (k % len(_LABELS)).cast("int"))
    said = F.when(k % 2 == 0, "Our next question comes from the line of Ann Lee.").otherwise("Please stand by.")
    issuers = F.array(F.lit("Someone Else, Other Firm - CEO"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", roles.is_ceo(name).alias("ceo"), roles.is_special_ceo(name).alias("special"), roles.is_analyst(name, issuers).alias("analyst"), roles.is_operator(name).alias("operator"),
        roles.is_next_question(name, said).alias("next_question"), roles.ceo_signal(name).alias("ceo_signal"), roles.analyst_signal(name).alias("analyst_signal"),
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal, CAST(round_even(c_custkey * 37.5, 0) AS BIGINT) AS s FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 3 = 0 THEN 'First ' || c_mktsegment ELSE c_name END AS person, c_mktsegment || ';Z' AS flags, CASE WHEN k % 4 >= 2 THEN k END AS optional, CASE WHEN k % 5 > 1 THEN c_acctbal END AS finite,
       CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration,
       CASE WHEN k % 2 = 0 THEN 'a' ELSE '' END AS shared, CASE WHEN k % 2 = 0 THEN 'a;b;c' ELSE 'a;b;c;d' END AS united, k AS strict FROM c""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-25, T-27, N-4, M-1, M-10, O-2."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    number = F.when(k % 4 == 0, "").when(k % 4 == 1, "x1").otherwise(k.cast("string"))
    value = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("inf")).otherwise(F.col("c_acctbal").cast("double"))
    letters = lambda text: F.split(F.lit(text), ";")
    sets = contracts.label_sets(letters("b;a"), F.when(k % 2 == 0, letters("c;a")).otherwise(letters("d;c")))
    either = F.array_union(sets["either"], F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))))
    return table(spark, sf_dir, "customer").select(
        k, person_name(F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")), F.lit("First"), segment).alias("person"), F.array_join(text_set(F.concat_ws(";", segment, F.lit(""), segment, F.lit("Z"))), ";").alias("flags"),
        stats.optional_int(number).alias("optional"), stats.finite(value).alias("finite"), duration_text(k * 37.5).alias("duration"),
        F.array_join(sets["both"], ";").alias("shared"), F.array_join(either, ";").alias("united"), stats.strict_int(F.concat(F.lit(" "), k.cast("string")), 0).alias("strict"),
    )


@query("SELECT conv_id || '_' || turn AS custom_id, CASE (conv_id + turn) % 4 WHEN 1 THEN 'messages' ELSE 'empty_content' END AS violations FROM conversations WHERE (conv_id + turn) % 4 IN (1, 2)")
def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-9: requests whose second message has the wrong role, or an empty one."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    said = F.concat(F.lit("x"), F.coalesce("text", F.lit("")))
    messages = F.array(message(F.lit("system"), F.lit("score")), message(F.when(k == 1, "assistant").otherwise("user"), F.when(k == 2, "  ").otherwise(said)))
    return scoring.request_violations(table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("custom_id"), messages.alias("messages")))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'output status is not completed' WHEN 2 THEN 'missing or invalid EOS termination evidence' WHEN 3 THEN 'input truncation/rejection evidence missing or invalid' WHEN 4 THEN 'invalid generated-token/EOS evidence'
       WHEN 5 THEN 'full decoded response differs from payload plus terminal EOS' WHEN 6 THEN 'stored parsed output differs from strict whole-raw parse' ELSE '' END AS error FROM labels""")
def result_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11: results with one broken piece of evidence each."""
    k = F.col("doc_id") % 7
    score = F.when(F.col("quality") == 1, 4).otherwise(2)
    answer = F.format_string('{"ok":1,"specificity":%d}', score)
    ids = F.when(k == 4, F.array(F.lit(2), F.lit(7), F.lit(2))).otherwise(F.array(F.lit(7), F.lit(8), F.lit(2)))
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(k == 1, "error").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("validation_error"), F.lit(False).alias("output_truncated"), F.when(k == 2, "length").otherwise("eos_token").alias("finish_reason"),
        F.lit(False).alias("input_truncated"), (k == 3).alias("input_context_rejected"), ids.alias("generated_token_ids"), F.lit(2).alias("terminal_eos_token_id"), F.array(F.lit(2)).alias("configured_eos_token_ids"), F.array(F.lit(2)).alias("tokenizer_special_token_ids"),
        F.lit("</s>").alias("terminal_eos_text"), answer.alias("raw_output"), F.concat(answer, F.when(k == 5, "").otherwise("</s>")).alias("raw_output_with_special_tokens"), F.when(k == 6, F.lit("{}")).otherwise(answer).alias("stored"),
    )
    return rows.select("doc_id", scoring.result_error(F.col("raw_output"), F.col("stored")).alias("error"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-3: three sources without a key in common."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return contracts.merge_sources(*[rows.filter(F.col("o_orderkey") % 3 == k) for k in range(3)], keys=["o_orderkey"])


@query("""SELECT o_orderkey AS event_id, CASE o_orderkey % 6 WHEN 1 THEN 'ok_with_notes' WHEN 3 THEN 'unknown_review_reason' WHEN 4 THEN 'unknown_status' ELSE 'bad_row_count' END AS violation FROM orders WHERE o_orderkey % 6 IN (1, 3, 4, 5)
UNION ALL SELECT o_orderkey, 'repeated_event' FROM orders WHERE o_orderkey % 60 = 0""")
def fetch_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-15."""
    k = F.col("o_orderkey") % 6
    audit = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.when(k.isin(2, 3), "review").when(k == 4, "done").otherwise("ok").alias("fetch_status"),
        F.when(k == 2, "duplicate_sequence_id").when(k.isin(1, 3), "other").alias("fetch_notes"), F.when(k == 5, -1).otherwise(3).alias("fetched_rows"),
    )
    return contracts.fetch_audit_violations(audit.unionByName(audit.filter("event_id % 60 = 0")))


@query("WITH c AS (SELECT c_custkey + 1 AS place FROM customer) SELECT place, CASE WHEN place = 23 THEN 'missing' ELSE 'changed' END AS violation FROM c WHERE place <= 50 AND (place = 23 OR place % 17 = 0) UNION ALL SELECT max(place), 'gap' FROM c")
def packet_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10: a packet whose first rows should be those of an earlier one."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("place"), "c_name", "c_acctbal")
    new = rows.filter("place <> 23").withColumn("c_name", F.when(F.col("place") % 17 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")))
    return contracts.prefix_violations(rows.filter("place <= 50"), new, "place")


@query("""SELECT c_custkey, 'policy_candidate' AS "column", CASE WHEN c_nationkey < 5 THEN 'true' ELSE 'false' END AS told, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_nationkey < 5 THEN 'false' ELSE 'true' END AS again FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 50 = 0
UNION ALL SELECT c_custkey, 'c_name', c_name, NULL FROM customer WHERE c_custkey % 50 = 0""")
def overlay_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10: an overlay's columns under a prefix, and its cells read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") < 5).alias("candidate"))
    told = contracts.overlay(rows, ["candidate"], "policy_")
    again = told.filter("c_custkey % 50 <> 0").withColumn("policy_candidate", F.when(F.col("c_custkey") % 9 == 0, ~F.col("policy_candidate")).otherwise(F.col("policy_candidate")))
    return contracts.differing_cells(told, again, ["c_custkey"])


@query("""WITH l AS (SELECT doc_id, quality AS q, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS t FROM labels)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN q ELSE CASE WHEN q = t THEN q END END AS quality, CASE doc_id % 3 WHEN 0 THEN 'only_theirs' WHEN 1 THEN 'only_mine' ELSE CASE WHEN q = t THEN 'same' ELSE 'conflict' END END AS status FROM l""")
def label_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-12, R-17: two files of labels."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    theirs = rows.filter("doc_id % 3 <> 1").withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return contracts.label_store(rows.filter("doc_id % 3 <> 0"), theirs, "doc_id", ["quality"])


@query("""SELECT audit_id, reference_state FROM (SELECT doc_id AS audit_id, CASE WHEN quality = 1 THEN 'scored' WHEN toxic = 0 THEN 'procedural_only' ELSE 'source_uninterpretable' END AS reference_state FROM labels)""")
def frozen_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13: human labels, refused if one is unfinished, published once and read back against their receipt."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    state = scoring.label_state(F.when(good, "substantive").when(toxic, "uncertain").otherwise("procedural_only"), F.when(good, 1).when(~toxic, 0), F.when(good, 3).when(~toxic, 0), F.lit("note"))["state"]
    path = new_path(spark, "frozen") + "/reference"
    publish.publish(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("audit_id"), state.alias("reference_state")), path, receipt={"status": "frozen"})
    publish.verify(spark, path)
    return spark.read.parquet(path)


@query("""SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' ELSE 'unexpected' END AS drift FROM nation WHERE n_nationkey % 5 < 3""")
def identity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-2: the parts of a run's identity that differ from those approved."""
    k = F.col("n_nationkey") % 5
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("value"), k.alias("k"))
    found = rows.filter("k <> 1").withColumn("value", F.when(F.col("k") == 0, "other").otherwise(F.col("value")))
    return contracts.identity_drift(rows.filter("k <> 2").drop("k"), found.drop("k"))


@query("""WITH t AS (SELECT conv_id AS event_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN 2 ELSE 1 END AS gate_rows, n AS turns_rows, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS blocks_rows,
       concat_ws(';', CASE WHEN event_id % 7 = 0 THEN 'no_gate_row' END, CASE WHEN event_id % 7 = 1 THEN 'repeated_gate_row' END, CASE WHEN event_id % 3 = 0 THEN 'blocks_rows_apart' END) AS violations FROM t""")
def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-9: turns and blocks by event; some events have no gate row, two of them, or blocks that stand apart."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"), "turn")
    events = turns.select("event_id").distinct()
    once = events.filter("event_id % 7 <> 0")
    first = turns.groupBy("event_id").agg(F.min("turn").alias("first"))
    placed = turns.join(first, "event_id").select("event_id", (F.row_number().over(attribution.Window.partitionBy("event_id").orderBy("turn")) + F.col("event_id") * 1000).alias("position"))
    blocks = events.filter("event_id % 3 = 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(5))).alias("position"))
    return contracts.streams_by_event(once.unionByName(events.filter("event_id % 7 = 1")), turns=placed, blocks=blocks)


@query("""WITH r AS (SELECT conv_id * 1000 + CASE WHEN conv_id % 10 = 0 AND turn = 0 THEN -1500 ELSE turn END AS position, conv_id AS event_id, strlen(coalesce(text, '')) + 1 AS n FROM conversations),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM r)
SELECT event_id, CAST(min(f) AS BIGINT) AS "begin", CAST(max(f + n) AS BIGINT) AS "end", count(*) AS records, max(f + n) - min(f) = sum(n) AS contiguous FROM o GROUP BY 1""")
def event_file_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: byte spans of the events in a file of turns; the first turn of some stands too early."""
    early = (F.col("conv_id") % 10 == 0) & (F.col("turn") == 0)
    position = F.col("conv_id") * 1000 + F.when(early, -1500).otherwise(F.col("turn"))
    length = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return contracts.event_spans(table(spark, sf_dir, "conversations").select(position.alias("position"), F.col("conv_id").alias("event_id"), length.cast("long").alias("length")))


@query("""WITH c AS (SELECT o_orderkey AS event_id, CAST(o_custkey % 7 AS VARCHAR) AS gvkey, o_custkey AS execid FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT l_orderkey AS event_id, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'review' ELSE 'usable_with_flag' END AS t FROM lineitem WHERE l_orderkey % 2 = 0),
te AS (SELECT DISTINCT CAST(c_custkey % 7 AS VARCHAR) AS gvkey, c_custkey AS execid FROM customer),
s AS (SELECT gvkey, execid, count(DISTINCT event_id) AS e, count(t) AS n, count(*) FILTER (t = 'high') AS h, count(*) FILTER (t = 'usable_with_flag') AS u, count(*) FILTER (t = 'review') AS r FROM te LEFT JOIN c USING (gvkey, execid) LEFT JOIN b USING (event_id) GROUP BY 1, 2),
tu AS (SELECT gvkey, execid AS o, lead(execid) OVER (PARTITION BY gvkey ORDER BY execid) AS x FROM te)
SELECT tu.gvkey, o AS old_execid, x AS new_execid, a.e AS old_confirmed_event_count, a.n AS old_candidate_block_count, a.h AS old_high_tier_block_count, a.u AS old_usable_with_flag_block_count, a.r AS old_review_block_count,
       z.e AS new_confirmed_event_count, z.n AS new_candidate_block_count, z.h AS new_high_tier_block_count, z.u AS new_usable_with_flag_block_count, z.r AS new_review_block_count, a.n > 0 AND z.n > 0 AS both_sides_have_candidate_blocks
FROM tu JOIN s a ON a.gvkey = tu.gvkey AND a.execid = o JOIN s z ON z.gvkey = tu.gvkey AND z.execid = x WHERE x IS NOT NULL""")
def turnover_block_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-19, A-14: blocks by tier of each turnover's two episodes."""
    key, flag = F.col("c_custkey"), F.col("l_returnflag")
    tenures = table(spark, sf_dir, "customer").select((key % 7).cast("string").alias("gvkey"), key.alias("execid"), F.lit(1).alias("tenure_episode"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 7).cast("string").alias("gvkey"), F.col("o_custkey").alias("execid"), F.lit(1).alias("tenure_episode"), (F.col("o_orderstatus") != "P").alias("confirmed"))
    found = table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("event_id"), F.when(flag == "A", "high").when(flag == "N", "review").otherwise("usable_with_flag").alias("quality_tier"))
    tiers = episodes.episode_tiers(tenures, calls, found, ["gvkey", "execid", "tenure_episode"])
    after = F.lead("execid").over(attribution.Window.partitionBy("gvkey").orderBy("execid"))
    pairs = tenures.select("gvkey", F.col("execid").alias("old_execid"), F.lit(1).alias("old_tenure_episode"), after.alias("new_execid"), F.lit(1).alias("new_tenure_episode")).filter("new_execid is not null")
    return episodes.turnover_tiers(pairs, tiers).drop("old_tenure_episode", "new_tenure_episode")


@query("""SELECT conv_id || '_b' AS block_id, conv_id AS event_id, CAST(conv_id % 5 AS VARCHAR) AS gvkey, conv_id % 9 AS expected_execid, 1 AS tenure_episode, 'Jane Roe' AS expected_ceo_name, 'a; b' AS validated_ceo_speaker, 'v1' AS speaker_gate_version FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0""")
def blocks_with_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14."""
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id")).distinct()
    gates = events.filter("event_id % 3 <> 0").select("event_id", (F.col("event_id") % 5).cast("string").alias("gvkey"), (F.col("event_id") % 9).alias("execid"), F.lit(1).alias("tenure_episode"), F.lit("Jane Roe").alias("expected_ceo_name"), F.array(F.lit("a"), F.lit("b")).alias("matched_shared_labels"))
    return gate.with_gate(events.select(F.concat(F.col("event_id").cast("string"), F.lit("_b")).alias("block_id"), "event_id"), gates, "v1")


@query(f"""WITH {attribution._RUNS} SELECT 'ccts_' || event_id || '_episode_' || first_turn AS block_id, event_id, answers FROM bl""")
def guarded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-3, W-10: questioners whose labels say nothing, known from a table of roles."""
    turns = domain.turns(spark, sf_dir)
    anchors = attribution.call_anchors(spark, sf_dir)
    known = turns.withColumns({"is_questioner": F.col("role") == "user", "is_unresolved": F.lit(False), "text_name": F.when(F.col("role") == "user", "Guest Speaker").otherwise(F.col("text_name"))})
    return episodes.blocks(known, anchors).select("block_id", "event_id", F.size("ceo_answer_sequence_ids").cast("long").alias("answers"))
