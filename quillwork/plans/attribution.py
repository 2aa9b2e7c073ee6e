"""Queries of the text attribution stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions import procedure
from quillwork.functions.names import best_match, relation
from quillwork.functions.text import affiliation, clean, content_hash, issuer_label, label, norm, ratio_text, speaker_key, title_company, word_count
from quillwork.operators import contracts, episodes, gate, units
from quillwork.operators.turns import fetch_audit as audit_turns
from quillwork.operators.turns import in_order, section
from quillwork.plans import domain
from quillwork.plans.registry import query
from quillwork.storage import written
from quillwork.tables import spread, table

_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
_NORM = r"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""SELECT doc_id, length(t) AS clean_length, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words, md5(n) AS norm_md5 FROM (SELECT doc_id, {_CLEAN.format(c="text")} AS t, {_NORM.format(c="text")} AS n FROM documents)""")
def clean_and_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1, T-2, T-6."""
    text = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.length(clean(text)).cast("long").alias("clean_length"), word_count(text).alias("words"), F.md5(norm(text)).alias("norm_md5"))


@query(
    f"""WITH l AS (SELECT s_suppkey, s_name || ', Firm ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ', Research Division' ELSE '' END || ' - Analyst [' || s_suppkey || ']' AS raw FROM supplier)
SELECT s_suppkey, regexp_replace(raw, ' \\[[0-9]+\\]$', '') AS label, {_NORM.format(c="split_part(raw, ' - ', 1)")} AS speaker_key, 'Firm ' || regexp_extract(raw, 'Firm ([0-9]+)', 1) AS affiliation,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Research Division' ELSE 'Firm ' || regexp_extract(raw, 'Firm ([0-9]+)', 1) END AS issuer_label FROM l""".replace("\\\\", "\\"),
    name="speaker_key",
)
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-7, T-8."""
    k = F.col("s_suppkey")
    raw = F.concat("s_name", F.lit(", Firm "), F.col("s_nationkey").cast("string"), F.when(k % 2 == 0, ", Research Division").otherwise(""), F.lit(" - Analyst ["), k.cast("string"), F.lit("]"))
    return table(spark, sf_dir, "supplier").select(k, raw.alias("raw")).select("s_suppkey", label(F.col("raw")).alias("label"), speaker_key(F.col("raw")).alias("speaker_key"), affiliation(F.col("raw")).alias("affiliation"), issuer_label(label(F.col("raw"))).alias("issuer_label"))


@query("""SELECT p_partkey, p_name AS company FROM part""")
def title_company_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-5: the company is left of each event title made around it."""
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat(F.lit("Q3 2010 "), "p_name", F.lit(" Earnings Conference Call"))).when(k == 1, F.concat("p_name", F.lit(" Fourth Quarter 2009 Earnings Call (Webcast)"))).when(k == 2, F.concat(F.lit("Full Year 2011 "), "p_name", F.lit(" Results Briefing"))).otherwise(F.concat("p_name", F.lit("'s fiscal year 2012 update")))
    return table(spark, sf_dir, "part").select("p_partkey", title_company(title).alias("company"))


@query("""SELECT s_suppkey, printf('%.3f', s_suppkey::DOUBLE / 7.0) AS ratio FROM supplier""")
def ratio_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-23; ties of the third decimal are fixture-tested."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", ratio_text(F.col("s_suppkey"), F.lit(7)).alias("ratio"))


@query("""SELECT doc_id, sha256(text) AS text_sha256, sha256(coalesce(lang, '') || chr(10) || text) AS pair_sha256 FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-26."""
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("text_sha256"), content_hash(F.col("lang"), F.col("text")).alias("pair_sha256"))


# What procedure sounds like: text, kind, whether it acknowledges, flags of a whole answer.
_PROCEDURE = [
    ("Thank you, operator. We will take your questions.", "question_invitation", False, ""), ("Thanks for joining us this morning.", "closing_only", False, "CEO_ANSWER_IS_CLOSING_REMARKS"),
    ("Thank you everyone for joining us. Margins will improve.", "", False, ""), ("I'll ask Bob to...", "delegation_only", False, ""), ("We grew--", "", False, "CEO_ANSWER_IS_INCOMPLETE_FRAGMENT"),
    ("So if I understand your question, you want the margin, is that correct?", "clarification_request", False, "CEO_ANSWER_IS_CLARIFICATION_REQUEST"), ("Hi. Good morning, John.", "greeting_only", False, ""),
    ("Hi John. Can you hear me okay?", "audio_check", False, ""), ("Could you repeat the question? We don't disclose that figure.", "", False, ""), ("Give Bob a second, he's looking it up.", "lookup_deferral", False, ""),
    ("Do you want to speak or do you want to join?", "logistics_question", False, ""), ("What's the call number and password?", "logistics_reply", False, ""), ("Um", "incomplete_fragment", False, ""), ("Yes, go ahead", "", True, ""), ("Yes, margins", "", False, ""),
]


@query(
    f"""WITH p(k, kind, ack, flags) AS (VALUES {", ".join(f"({k}, '{r[1]}', {str(r[2]).lower()}, '{r[3]}')" for k, r in enumerate(_PROCEDURE))}) SELECT conv_id, turn, coalesce(kind, '') AS kind, coalesce(ack, false) AS acknowledgement, coalesce(flags, '') AS answer_flags
FROM conversations LEFT JOIN p ON k = (conv_id + turn) % {2 * len(_PROCEDURE)}""",
    name="procedure_kind",
)
def procedure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12 to T-15 and T-18: half of the turns are of known procedure, the others the tables' prose, which has none."""
    said = F.get(F.array(*[F.lit(r[0]) for r in _PROCEDURE]), ((F.col("conv_id") + F.col("turn")) % (2 * len(_PROCEDURE))).cast("int"))
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.coalesce(said, F.col("text")).alias("t"))
    t = F.col("t")
    return rows.select("conv_id", "turn", procedure.procedure_kind(t).alias("kind"), procedure.acknowledgement(t).alias("acknowledgement"), F.array_join(procedure.answer_flags(t), ";").alias("answer_flags"))


@query(
    r"""SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(lower(text), '\([^)]*\b(inaudible|indiscernible|multiple speakers|technical difficulties)\b[^)]*\)') THEN 'source_text_gap' END,
       CASE WHEN regexp_matches(text, '(\.{3}|…|--|—)\s*[.!?]?\s*$') THEN 'trailing_source_fragment' END) AS defects FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' (some Inaudible words) there' WHEN 1 THEN ' we grew--' WHEN 2 THEN ' and (technical difficulties) ... ' ELSE '' END AS text FROM documents)"""
)
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-16, with gaps and broken ends added to three texts of five."""
    k = F.col("doc_id") % 5
    text = F.concat("text", F.when(k == 0, " (some Inaudible words) there").when(k == 1, " we grew--").when(k == 2, " and (technical difficulties) ... ").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(procedure.source_defects(text), ";").alias("defects"))


@query(
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Can you hear me?' WHEN 1 THEN 'Sorry, could you repeat the question?' WHEN 2 THEN text || ' Right?' WHEN 3 THEN text || ' Tell us more' ELSE text END AS text FROM documents), n AS (SELECT doc_id, text, {_NORM.format(c="text")} AS n FROM d)
SELECT doc_id, doc_id % 6 > 1 AND (text LIKE '%?%' OR regexp_matches(' ' || n || ' ', ' (what|when|where|why|how|could|can you|would you|do you|talk about|tell us|give us|help me|help us|wondering|curious|walk us|explain|quantify) ')) AS candidate FROM n""",
    name="question_candidate",
)
def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-17: two texts of six are whole procedure, which asks nothing; two have a question added."""
    k, text = F.col("doc_id") % 6, F.col("text")
    said = F.when(k == 0, "Can you hear me?").when(k == 1, "Sorry, could you repeat the question?").when(k == 2, F.concat(text, F.lit(" Right?"))).when(k == 3, F.concat(text, F.lit(" Tell us more"))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", procedure.question_candidate(said).alias("candidate"))


# A person's name, a label's, and how they relate; the surname gets letters that tell suppliers apart.
_NAMES = [
    ("Jane Q{}", "Jane Q{} Jr., Acme - CEO", "exact_full_name"), ("Robert Q{}", "Mr. Bob Q{}, Acme - CFO", "recognized_nickname_last_name"), ("Jane Q{}", "Jane Z{}, Acme - CEO", "no_match"),
    ("Jane Ann Q{}", "Dr. Jane Q{}, Acme - CEO", "same_first_last_middle_difference"), ("J Robert Q{}", "Robert Q{}", "initial_prefix_plus_given_name"), ("J Robert Q{}", "Bob Q{} - CEO", "initial_prefix_plus_recognized_nickname"),
    ("John Q{}", "Judith Q{}, Acme", "same_initial_last_name_review"), ("John Q{}", "Mary Q{}, Acme", "same_last_name_different_first_name"), ("Q{}", "Jane Q{}", "no_match"),
]


@query(f"""WITH n(k, relation) AS (VALUES {", ".join(f"({k}, '{r[2]}')" for k, r in enumerate(_NAMES))}) SELECT s_suppkey, relation FROM supplier JOIN n ON k = s_suppkey % {len(_NAMES)}""")
def name_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-9, T-10: nine pairs of names, one for each relation but the transcription variants."""
    k = F.col("s_suppkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    pick = lambda at: F.replace(F.get(F.array(*[F.lit(r[at]) for r in _NAMES]), (k % len(_NAMES)).cast("int")), F.lit("{}"), letters)
    return table(spark, sf_dir, "supplier").select("s_suppkey", relation(pick(0), pick(1)).alias("relation"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'exact_full_name' WHEN 1 THEN 'same_initial_last_name_review' WHEN 2 THEN 'same_last_name_different_first_name' ELSE 'exact_full_name' END AS quality, CASE WHEN s_suppkey % 4 = 3 THEN 'Jane Doe - CEO;Jane Doe, Acme - CEO' WHEN s_suppkey % 4 = 0 THEN 'Jane Doe, Acme - CEO' WHEN s_suppkey % 4 = 1 THEN 'Judith Doe, Acme - CEO' ELSE 'Mary Doe - Analyst' END AS labels FROM supplier""")
def best_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-11, J-16."""
    k = F.col("s_suppkey")
    labels = F.array(F.lit("John Smith, Acme - CFO"), F.when(k % 4 == 1, "Judith Doe, Acme - CEO").when(k % 4 == 2, "Jane Smith").otherwise("Jane Doe, Acme - CEO"), F.lit("Mary Doe - Analyst"), F.when(k % 4 == 3, "Jane Doe - CEO").otherwise("Ed Fox"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", best_match(F.lit("Jane Doe"), labels).alias("m")).select("s_suppkey", "m.quality", F.array_join(F.array_sort("m.labels"), ";").alias("labels"))


@query(
    """WITH t AS (SELECT conv_id AS event_id, count(*) AS fetched_rows, count(*) FILTER (role = 'system') AS pre, count(*) FILTER (role <> 'system') AS qa, count(DISTINCT turn) AS ids, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1),
m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE pre END AS expected_pre_rows, CASE WHEN event_id % 5 = 0 THEN qa + 1 ELSE qa END AS expected_qa_rows FROM t UNION ALL SELECT event_id + 1000000, NULL, NULL FROM t)
SELECT m.event_id, expected_pre_rows, expected_qa_rows, coalesce(fetched_rows, 0) AS fetched_rows, coalesce(pre, 0) AS fetched_pre_rows, coalesce(qa, 0) AS fetched_qa_rows, coalesce(fetched_rows, 0) AS database_rows, lo AS database_min_sequence_id, hi AS database_max_sequence_id,
       concat_ws(';', CASE WHEN fetched_rows IS NULL THEN 'no_database_text_rows' END, CASE WHEN coalesce(pre, 0) <> expected_pre_rows THEN 'pre_count_mismatch' END, CASE WHEN coalesce(qa, 0) <> expected_qa_rows THEN 'qa_count_mismatch' END, CASE WHEN ids <> fetched_rows THEN 'duplicate_sequence_id' END) AS fetch_notes,
       CASE WHEN fetched_rows IS NULL OR coalesce(pre, 0) <> expected_pre_rows OR coalesce(qa, 0) <> expected_qa_rows OR ids <> fetched_rows THEN 'review' ELSE 'ok' END AS fetch_status FROM m LEFT JOIN t USING (event_id)"""
)
def fetch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, C-16."""
    turns = domain.turns(spark, sf_dir)
    of = turns.groupBy("event_id").agg(F.count_if(F.col("section") == "PRE").alias("pre"), F.count_if(F.col("section") == "Q&A").alias("qa"))
    expected = of.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("pre")).alias("expected_pre_rows"), F.when(F.col("event_id") % 5 == 0, F.col("qa") + 1).otherwise(F.col("qa")).alias("expected_qa_rows"))
    unknown = of.select((F.col("event_id") + 1_000_000).alias("event_id"), F.lit(None).cast("long").alias("expected_pre_rows"), F.lit(None).cast("long").alias("expected_qa_rows"))
    return audit_turns(expected.unionByName(unknown), turns)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PRE' WHEN 1 THEN 'Q&A' ELSE 'OTHER' END AS section FROM documents""")
def section_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3."""
    k = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select("doc_id", section(F.when(k == 0, "PRE").when(k == 1, "Q&A").when(k == 2, "pre").when(k == 3, F.col("lang"))).alias("section"))


@query("""SELECT conv_id AS event_id, turn AS sequence_id, conv_id % 7 AS assignment_rank FROM conversations""")
def ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-6, K-7."""
    turns = domain.turns(spark, sf_dir)
    ranks = turns.select("event_id", (F.col("event_id") % 7).alias("assignment_rank")).distinct()
    return in_order(turns, ranks).select("event_id", "sequence_id", "assignment_rank")


_ALIAS = """WITH a AS (SELECT sha256(text) AS k, source AS name, n_chars FROM documents), g AS (SELECT k, count(*) AS rows, string_agg(DISTINCT name, ';' ORDER BY name) AS alias_names, min(name) AS kept_name, count(DISTINCT name) AS names, count(DISTINCT n_chars) AS payloads FROM a GROUP BY 1)"""


@query(f"""{_ALIAS} SELECT k AS text_key, rows, kept_name, alias_names, CASE WHEN rows = 1 THEN 'unique' WHEN payloads > 1 THEN 'error_payload_differs' WHEN rows = 2 AND names = 2 THEN 'exact_alias' ELSE 'error_not_two_aliases' END AS status FROM g""")
def alias_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8, P-13."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_key"), F.col("source").alias("name"), "n_chars")
    return contracts.resolve_aliases(docs, ["text_key"], "name", ["n_chars"]).drop("payload_sha256")


@query(f"""{_ALIAS}, s AS (SELECT CASE WHEN rows = 1 THEN 'unique' WHEN payloads > 1 THEN 'error_payload_differs' WHEN rows = 2 AND names = 2 THEN 'exact_alias' ELSE 'error_not_two_aliases' END AS status, rows FROM g) SELECT status, count(*) AS keys, CAST(sum(rows) AS BIGINT) AS rows FROM s GROUP BY 1""")
def alias_resolution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8."""
    return alias_dedup(spark, sf_dir).groupBy("status").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side
FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k""")
def key_domain_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1, J-7, J-13."""
    return contracts.reconcile_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("""SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-7."""
    return contracts.key_violations(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT o_custkey, o_orderstatus, 'left_only' AS side FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT o_custkey, o_orderstatus, 'right_only' FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)""")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-3, R-10."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return contracts.difference(o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 3 = 0").drop("o_orderkey"))


@query("""WITH h AS (SELECT conv_id, turn, sha256(CAST(to_json({'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) AS h FROM conversations) SELECT conv_id, sha256(string_agg(h, '' ORDER BY turn, h)) AS payload_sha256 FROM h GROUP BY 1""")
def payload_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-13: a fingerprint of each conversation's turns."""
    return contracts.group_fingerprint(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "role", "text")


_SOURCES = "x AS (SELECT o_orderkey AS id, 0 AS k FROM orders WHERE o_orderkey % 4 = 0 UNION SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 6 = 0 UNION SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 9 = 0)"


def _exclusions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return {name: o.filter(F.col("event_id") % n == 0) for name, n in (("first", 4), ("second", 6), ("third", 9))}


@query(f"""WITH {_SOURCES}, f AS (SELECT id, min(k) AS first FROM x GROUP BY 1) SELECT CASE k WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS source, k AS source_order, count(*) AS ids, count(*) FILTER (k = first) AS new_to_union FROM x JOIN f USING (id) GROUP BY k""")
def prior_exclusion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-4."""
    return contracts.exclusion_union(_exclusions(spark, sf_dir), "event_id")


@query("""SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0""")
def prior_exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-18, SRC-16: events whose id is in no prior sample; the samples name them in several ways."""
    sources = _exclusions(spark, sf_dir)
    given = sources["first"].select(contracts.exclusion_event_id(F.col("event_id").cast("string"), F.lit("")).alias("event_id"))
    for s in ("second", "third"):
        given = given.unionByName(sources[s].select(contracts.exclusion_event_id(F.lit(""), F.lit(""), F.format_string("qa_%d_4", F.col("event_id"))).alias("event_id")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")).join(given, "event_id", "left_anti")


_CALLS_WITH = """SELECT conv_id, bool_or(role = 'system') AS pre, bool_or(role = 'assistant') AS qa FROM conversations GROUP BY 1"""


@query(f"""SELECT conv_id AS event_id, 'PRE' AS section, 'jane roe acme' AS speaker_key, '{domain.EXECUTIVE}' AS labels FROM ({_CALLS_WITH}) WHERE pre UNION ALL SELECT conv_id, 'Q&A', 'jane roe acme', '{domain.EXECUTIVE}' FROM ({_CALLS_WITH}) WHERE qa""")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-1, N-2."""
    return gate.candidate_evidence(domain.turns(spark, sf_dir)).withColumn("labels", F.array_join("labels", "; "))


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = domain.turns(spark, sf_dir)
    name = F.when(F.col("event_id") % 4 == 0, "J. Roe").when(F.col("event_id") % 4 == 1, "Mary Poe").otherwise("Jane Roe")
    return gate.identity(gate.candidate_evidence(turns), turns.select("event_id").distinct().withColumn("expected_ceo_name", name))


_IDENTITY = f"""id AS (SELECT conv_id AS event_id, pre, qa, CASE WHEN pre AND qa THEN 'exact_single_shared_speaker_key' ELSE 'review_or_no_shared_speaker_key' END AS within_call_identity_status,
       CASE WHEN pre AND qa THEN CASE conv_id % 4 WHEN 0 THEN 'review_external_ceo_initial_last_name' WHEN 1 THEN 'mismatch_external_ceo_vs_shared_speaker' ELSE 'confirmed_external_ceo_shared_pre_qa' END
            WHEN (pre OR qa) AND conv_id % 4 > 1 THEN 'review_external_ceo_present_one_section' ELSE 'not_confirmed_external_ceo_not_title_labelled' END AS external_speaker_validation_status FROM ({_CALLS_WITH}))"""


@query(f"""WITH {_IDENTITY} SELECT event_id, within_call_identity_status, CASE WHEN pre AND qa THEN '' ELSE 'NO_SHARED_PRE_QA_CEO_LABEL' END AS identity_flags, external_speaker_validation_status, external_speaker_validation_status LIKE 'confirmed%' AS event_speaker_gate_pass FROM id""")
def identity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-8, J-17, C-6, C-8."""
    return _identity(spark, sf_dir).select("event_id", "within_call_identity_status", "identity_flags", "external_speaker_validation_status", "event_speaker_gate_pass")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = _identity(spark, sf_dir).select((k % 5).cast("string").alias("gvkey"), (k % 10).alias("execid"), F.lit(1).alias("tenure_episode"), F.concat(F.lit("Q"), (k % 7).cast("string")).alias("calendar_quarter"), "external_speaker_validation_status", "event_speaker_gate_pass")
    return gate.episode_gate(rows, 1, 1)


_GATES = f"""{_IDENTITY}, ga AS (SELECT CAST(event_id % 5 AS VARCHAR) AS gvkey, event_id % 10 AS execid, count(*) AS fetched_events, count(*) FILTER (external_speaker_validation_status LIKE 'confirmed%') AS confirmed_calls,
       count(DISTINCT event_id % 7) FILTER (external_speaker_validation_status LIKE 'confirmed%') AS confirmed_distinct_quarters FROM id GROUP BY 1, 2)"""


@query(f"""WITH {_GATES} SELECT *, confirmed_calls >= 1 AND confirmed_distinct_quarters >= 1 AS episode_analysis_gate_pass FROM ga""")
def episode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12."""
    return _gates(spark, sf_dir).drop("tenure_episode", "speaker_status_counts_json")


@query(
    f"""WITH {_GATES}, tu AS (SELECT DISTINCT 't' || gvkey AS turnover_id, gvkey, CAST(gvkey AS BIGINT) AS old_execid, CAST(gvkey AS BIGINT) + 5 AS new_execid FROM ga),
j AS (SELECT tu.*, coalesce(a.confirmed_calls, 0) AS old_confirmed_calls, coalesce(b.confirmed_calls, 0) AS new_confirmed_calls FROM tu LEFT JOIN ga a ON a.gvkey = tu.gvkey AND a.execid = old_execid LEFT JOIN ga b ON b.gvkey = tu.gvkey AND b.execid = new_execid)
SELECT *, old_confirmed_calls >= 1 AS old_episode_gate_pass, new_confirmed_calls >= 1 AS new_episode_gate_pass, CASE WHEN old_confirmed_calls >= 1 AND new_confirmed_calls >= 1 THEN 'pass_both_episodes' WHEN old_confirmed_calls < 1 AND new_confirmed_calls < 1 THEN 'fail_both_episode_gates'
       WHEN old_confirmed_calls < 1 THEN 'fail_old_episode_gate' ELSE 'fail_new_episode_gate' END AS turnover_gate_status, old_confirmed_calls >= 1 AND new_confirmed_calls >= 1 AS turnover_analysis_gate_pass FROM j"""
)
def turnover_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13, C-7."""
    gates = _gates(spark, sf_dir)
    firm = F.col("gvkey").cast("long")
    pairs = gates.select(F.concat(F.lit("t"), "gvkey").alias("turnover_id"), "gvkey", firm.alias("old_execid"), F.lit(1).alias("old_tenure_episode"), (firm + 5).alias("new_execid"), F.lit(1).alias("new_tenure_episode")).distinct()
    return gate.turnover_gate(pairs, gates).drop("old_tenure_episode", "new_tenure_episode")


def call_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, shared_keys, shared_labels and flags of each call."""
    return _identity(spark, sf_dir).select("event_id", "shared_keys", "shared_labels", F.filter(F.split("identity_flags", ";"), lambda f: f != "").alias("flags"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns, found = domain.turns(spark, sf_dir), written(call_anchors(spark, sf_dir), "anchors")
    return turns, found, written(episodes.blocks(turns, found), "blocks")


_RUNS = f"""rn AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' AND coalesce(prev, '') <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block_no FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role <> 'system')),
bl AS (SELECT conv_id AS event_id, block_no, min(turn) FILTER (role = 'user') AS first_turn, count(*) FILTER (role = 'assistant') AS answers, string_agg(CASE WHEN role = 'assistant' THEN {_CLEAN.format(c="text")} END, chr(10) || chr(10) ORDER BY turn) AS answer
       FROM rn JOIN (SELECT conv_id, turn, role, text FROM conversations) USING (conv_id, turn, role) WHERE block_no > 0 AND conv_id IN (SELECT conv_id FROM ({_CALLS_WITH}) WHERE pre AND qa) GROUP BY 1, 2 HAVING count(*) FILTER (role = 'assistant') > 0)"""


@query(f"""WITH {_RUNS} SELECT 'ccts_' || event_id || '_episode_' || first_turn AS block_id, event_id, answers, sha256(answer) AS ceo_answer_sha256 FROM bl""")
def qa_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-1, E-2, E-8, T-20: in these tables an episode is a run of a user's turns and the answers to it."""
    return _blocks(spark, sf_dir)[2].select("block_id", "event_id", F.size("ceo_answer_sequence_ids").cast("long").alias("answers"), F.sha2("ceo_answer", 256).alias("ceo_answer_sha256"))


# Most questions get a question mark; every sixth call has a gap in each answer.
_ASKED, _GAP = " What do you expect?", " (inaudible) now."
_PLANTED = f"""pl AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 6 <> 0 THEN coalesce(text, '') || '{_ASKED}' WHEN role = 'assistant' AND conv_id % 6 = 1 THEN coalesce(text, '') || '{_GAP}' ELSE text END AS text FROM conversations),
gt AS (SELECT conv_id, bool_or(role = 'system') AND bool_or(role = 'assistant') AS gate FROM conversations GROUP BY 1),
rn AS (SELECT *, sum(CASE WHEN role = 'user' AND coalesce(prev, '') <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block_no FROM (SELECT *, {_CLEAN.format(c="text")} AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM pl WHERE role <> 'system')),
bq AS (SELECT conv_id AS event_id, min(turn) FILTER (role = 'user') AS first_turn, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user' AND t <> '') AS q, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND t <> '') AS a
       FROM rn JOIN gt USING (conv_id) WHERE block_no > 0 AND gate GROUP BY conv_id, block_no HAVING count(*) FILTER (role = 'assistant') > 0),
bd AS (SELECT 'ccts_' || event_id || '_episode_' || first_turn AS block_id, event_id, coalesce(q, '') AS q, coalesce(a, '') AS a, len(regexp_split_to_array(q, '\\s+')) AS qw, len(regexp_split_to_array(a, '\\s+')) AS aw, event_id % 6 = 1 AS gap,
       q LIKE '%?%' OR regexp_matches(' ' || {_NORM.format(c="q")} || ' ', ' (what|when|where|why|how|could|can you|would you|do you|talk about|tell us|give us|help me|help us|wondering|curious|walk us|explain|quantify) ') AS asked FROM bq),
dc AS (SELECT *, asked AND NOT gap AS high, concat_ws(';', CASE WHEN NOT asked THEN 'ANALYST_QUESTION_APPLICABILITY_REVIEW' END, CASE WHEN gap THEN 'CEO_SOURCE_TEXT_GAP_REVIEW;source_text_gap' END) AS why FROM bd)"""


def _planted_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, role, text = F.col("event_id") % 6, F.col("role"), F.coalesce("text_contents", F.lit(""))
    said = F.when((role == "user") & (k != 0), F.concat(text, F.lit(_ASKED))).when((role == "assistant") & (k == 1), F.concat(text, F.lit(_GAP))).otherwise(F.col("text_contents"))
    turns, anchors = domain.turns(spark, sf_dir).withColumn("text_contents", said), written(call_anchors(spark, sf_dir), "anchors")
    return turns, anchors, written(episodes.blocks(turns, anchors), "blocks")


@query(f"""WITH {_PLANTED} SELECT event_id, count(*) AS blocks, count(*) FILTER (high) AS high_blocks, 0 AS usable_with_flag_blocks, count(*) FILTER (NOT high) AS review_blocks FROM dc GROUP BY 1""")
def block_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-13, A-14."""
    return episodes.tier_counts(_planted_blocks(spark, sf_dir)[2], "event_id")


@query(f"""WITH {_RUNS}, n AS (SELECT event_id, count(*) AS b FROM bl GROUP BY 1) SELECT conv_id AS event_id, coalesce(b, 0) AS eligible_ceo_qa_blocks, CASE WHEN NOT (pre AND qa) THEN 'exclude_no_same_ceo' WHEN b IS NULL THEN 'review_no_ceo_answer_to_analyst_question' ELSE 'usable' END AS event_audit_status FROM ({_CALLS_WITH}) LEFT JOIN n ON event_id = conv_id""")
def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-14."""
    _, anchors, found = _blocks(spark, sf_dir)
    return episodes.event_audit(anchors, found).drop("high_quality_blocks")


@query(f"""WITH {_RUNS}, b AS (SELECT 'ccts_' || event_id || '_episode_' || first_turn AS block_id, event_id % 4 AS k FROM bl)
SELECT block_id, CASE k WHEN 0 THEN 'answer_differs' ELSE 'answer_outside_context;context_differs' END AS violations FROM b WHERE k < 2 UNION ALL SELECT block_id || ';' || block_id || '_again', 'shared_turn' FROM b JOIN bl ON block_id = 'ccts_' || event_id || '_episode_' || first_turn, range(answers) WHERE k = 2""")
def block_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-4, O-5, O-7: blocks whose answer is changed, whose context is dropped, or that another block repeats."""
    turns, _, found = _blocks(spark, sf_dir)
    k = F.col("event_id") % 4
    none = F.array().cast("array<long>")
    broken = found.withColumns({"ceo_answer": F.when(k == 0, F.concat("ceo_answer", F.lit("!"))).otherwise(F.col("ceo_answer")), "context_sequence_ids": F.when(k == 1, none).otherwise(F.col("context_sequence_ids"))})
    twice = broken.unionByName(broken.filter(k == 2).withColumn("block_id", F.concat("block_id", F.lit("_again"))))
    shared = episodes.shared_answer_turns(twice).select(F.array_join("owners", ";").alias("block_id"), F.lit("shared_turn").alias("violations"))
    return episodes.block_violations(broken, turns).unionByName(shared)


_CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace({_CLEAN.format(c="text")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE {_CLEAN.format(c="text")} <> ''),
e AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM d), h AS (SELECT doc_id, i, string_split(s, ' ') AS w FROM e),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS i, w[150 * k + 1 : 150 * k + 150] AS w FROM (SELECT doc_id, i, w, unnest(range(0, (len(w) - 1) // 150 + 1)) AS k FROM h)),
g AS (SELECT doc_id, i, len(w) AS n, len(w) AS held, 1 AS chunk FROM p WHERE i = 1
      UNION ALL SELECT p.doc_id, p.i, len(p.w), CASE WHEN g.held + len(p.w) > 150 THEN len(p.w) ELSE g.held + len(p.w) END, CASE WHEN g.held + len(p.w) > 150 THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1),
z AS (SELECT doc_id, max(chunk) AS last, arg_max(held, i) AS tail FROM g GROUP BY 1),
c AS (SELECT g.doc_id, CASE WHEN chunk = last AND last > 1 AND tail < 50 THEN chunk - 1 ELSE chunk END AS chunk_index, g.i, w FROM g JOIN z USING (doc_id) JOIN p ON p.doc_id = g.doc_id AND p.i = g.i)
SELECT doc_id, chunk_index, sum(len(w)) AS word_count, string_agg(array_to_string(w, ' '), ' ' ORDER BY i) AS segment FROM c GROUP BY 1, 2"""


@query(f"""SELECT doc_id, chunk_index, CAST(word_count AS BIGINT) AS word_count, 'uncertain' AS content_class, 'nonprocedural_text_retained_without_semantic_classification' AS content_reason, '' AS source_review_reasons, 'proposed' AS unit_status, segment FROM ({_CHUNKS})""")
def pre_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-19, E-6, W-9, C-9 over documents, whose prose is no procedure."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_contents")))
    return units.pre_units(docs, ["doc_id"])


@query(f"""SELECT doc_id FROM documents WHERE doc_id % 5 < 2 AND {_CLEAN.format(c="text")} <> ''""")
def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-19: chunks joined are the cleaned text, but for texts whose first chunk is dropped or whose last is changed."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_contents")))
    k = F.col("doc_id") % 5
    cut = docs.select("doc_id", F.posexplode(units.chunks(F.col("text_contents"))).alias("k", "segment")).select("doc_id", (F.col("k") + 1).alias("chunk_index"), "segment")
    broken = cut.filter((k != 0) | (F.col("chunk_index") > 1)).withColumn("segment", F.when(k == 1, F.concat("segment", F.lit("x"))).otherwise(F.col("segment")))
    return units.chunk_violations(docs, broken, ["doc_id"])


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    turns, anchors, found = _planted_blocks(spark, sf_dir)
    context = units.management_context(found, turns, anchors)
    return turns, anchors, found, units.classify_blocks(found, context)


@query(f"""WITH {_PLANTED} SELECT block_id, event_id, aw AS words, CASE WHEN high THEN 'proposed_primary' ELSE 'source_or_boundary_review' END AS inclusion_status, CASE WHEN high THEN 'high_tier_source_screen_pass' ELSE why END AS inclusion_reason, high AS policy_primary, high AS strict_robustness, false AS added_identified_management FROM dc""")
def block_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7, C-9, C-10, C-12."""
    decided = _decisions(spark, sf_dir)[3]
    policy = units.answer_policy(F.col("primary_block_candidate"), F.col("management_context_block_candidate"), F.col("inclusion_status"), F.col("inclusion_reason"))
    return decided.withColumn("p", policy).select("block_id", "event_id", "words", "inclusion_status", "inclusion_reason", "p.policy_primary", "p.strict_robustness", "p.added_identified_management")


@query(f"""WITH {_PLANTED} SELECT block_id, event_id, aw AS unit_word_count, qw AS question_word_count, concat_ws(';', CASE WHEN gap THEN 'source_text_gap' END, CASE WHEN NOT high THEN 'not_high_tier' END) AS exclusion_reasons,
       CAST(to_json({{'unit_type': 'qa', 'analyst_question': q, 'ceo_answer': a}}) AS VARCHAR) AS prompt_input_json FROM dc""")
def qa_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-7, N-5, T-18."""
    return units.qa_units(_planted_blocks(spark, sf_dir)[2])


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, anchors, _, decided = _decisions(spark, sf_dir)
    ceo = turns.filter("role <> 'user'").withColumn("words", word_count(F.col("text_contents")))
    words = lambda s: F.coalesce(F.sum(F.when(F.col("section") == s, F.col("words"))), F.lit(0).cast("long"))
    source = ceo.groupBy("event_id").agg(words("PRE").alias("source_pre_words"), words("Q&A").alias("source_qa_words"))
    pre = units.pre_units(turns.filter("section = 'PRE'"), ["event_id", "sequence_id"])
    calls = anchors.select("event_id", (F.size("shared_keys") == 1).alias("speaker_gate_pass"))
    return units.call_ledger(calls, pre, decided, source)


@query(
    f"""WITH {_PLANTED} SELECT conv_id AS event_id, CAST(coalesce(sum(n) FILTER (role = 'system'), 0) AS BIGINT) AS source_pre_words, CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS source_qa_words, true AS ledger_reconciles
FROM (SELECT conv_id, role, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT conv_id, role, {_CLEAN.format(c="text")} AS t FROM pl)) GROUP BY 1"""
)
def word_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15: the words by status add up to the source's."""
    return _ledger(spark, sf_dir).select("event_id", "source_pre_words", "source_qa_words", "ledger_reconciles")


@query(
    f"""WITH {_PLANTED}, w AS (SELECT conv_id AS event_id, sum(n) FILTER (role = 'system') AS pre, count(*) FILTER (role = 'system' AND n > 0) AS units, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS qa FROM (SELECT conv_id, role, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT conv_id, role, {_CLEAN.format(c="text")} AS t FROM pl)) GROUP BY 1),
b AS (SELECT event_id, count(*) AS candidates, sum(aw) AS words, count(*) FILTER (high) AS blocks, coalesce(sum(aw) FILTER (high), 0) AS primary_words FROM dc GROUP BY 1),
j AS (SELECT event_id, gate, coalesce(pre, 0) AS pre, units > 0 AS ready, qa, coalesce(candidates, 0) AS candidates, coalesce(words, 0) AS words, coalesce(blocks, 0) AS blocks, coalesce(primary_words, 0) AS pw FROM w JOIN gt ON conv_id = event_id LEFT JOIN b USING (event_id)),
l AS (SELECT *, gate AND ready AND blocks > 0 AS lane FROM j)
SELECT event_id, CAST(pre AS BIGINT) AS proposed_pre_words, CAST(pw AS BIGINT) AS primary_qa_words, CAST(words AS BIGINT) AS candidate_qa_words, CAST(qa - words AS BIGINT) AS unassigned_ceo_qa_words, lane AS primary_call_candidate, lane AS management_context_call_candidate, lane AND blocks >= 2 AND pw >= 100 AND pw >= 0.25 * qa AS qa_coverage_call_candidate,
       CASE WHEN NOT gate THEN 'speaker_gate_failed' WHEN NOT ready THEN 'no_source_screened_nonprocedural_pre_unit' WHEN lane THEN 'proposed_primary_pair' WHEN candidates = 0 THEN 'no_extracted_ceo_qa_block' ELSE 'no_primary_or_management_context_qa_block' END AS call_decision_reason FROM l"""
)
def call_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15, C-11."""
    return _ledger(spark, sf_dir).select("event_id", "proposed_pre_words", "primary_qa_words", "candidate_qa_words", "unassigned_ceo_qa_words", "primary_call_candidate", "management_context_call_candidate", "qa_coverage_call_candidate", "call_decision_reason")


_LANES = """WITH c AS (SELECT o_orderkey AS e, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS gvkey, o_custkey AS execid, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS q, o_orderstatus = 'F' AS p, o_orderstatus <> 'O' AS m, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS v FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT gvkey, execid, execid % 4 <> 0 AS gate, count(*) FILTER (p) AS pc, count(DISTINCT q) FILTER (p) AS pq, count(*) FILTER (m) AS mc, count(DISTINCT q) FILTER (m) AS mq, count(*) FILTER (v) AS vc, count(DISTINCT q) FILTER (v) AS vq FROM c GROUP BY 1, 2)"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    calls = joined.select(
        F.col("o_orderkey").alias("event_id"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("gvkey"), F.col("o_custkey").alias("execid"), F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias("calendar_quarter"),
        (status == "F").alias("primary_call_candidate"), (status != "O").alias("management_context_call_candidate"), ((F.col("o_orderpriority") == "1-URGENT") & (status == "F")).alias("qa_coverage_call_candidate"),
    )
    tenures = calls.select("gvkey", "execid").distinct().withColumn("episode_analysis_gate_pass", F.col("execid") % 4 != 0)
    return calls, units.lane_support(calls, tenures, ["gvkey", "execid"])


@query(
    f"""{_LANES}
SELECT gvkey, execid, pc AS primary_calls, pq AS primary_quarters, gate AND pc >= 5 AND pq >= 5 AS primary_episode_candidate, CASE WHEN gate AND pc >= 5 AND pq >= 5 THEN 'meets_support' WHEN NOT gate THEN 'speaker_episode_gate_failed' ELSE 'insufficient_paired_calls_or_distinct_quarters' END AS primary_reason,
       mc AS management_context_calls, gate AND mc >= 5 AND mq >= 5 AS management_context_episode_candidate, vc AS qa_coverage_calls, gate AND vc >= 5 AND vq >= 5 AS qa_coverage_episode_candidate FROM g"""
)
def lane_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16."""
    out = _lanes(spark, sf_dir)[1]
    return out.select("gvkey", "execid", "primary_calls", "primary_quarters", "primary_episode_candidate", "primary_reason", "management_context_calls", "management_context_episode_candidate", "qa_coverage_calls", "qa_coverage_episode_candidate")


@query(
    f"""WITH {domain.UNITS_SQL}, q AS (SELECT event_id, sequence_id, words, CASE WHEN sequence_id % 3 = 0 THEN 'unresolved' ELSE 'assigned_answer' END AS category, sequence_id % 4 <> 2 AS eligible FROM u WHERE section = 'Q&A'),
s AS (SELECT event_id, CAST(sum(words) AS BIGINT) AS raw, CAST(coalesce(sum(words) FILTER (category = 'assigned_answer'), 0) AS BIGINT) AS assigned, CAST(coalesce(sum(words) FILTER (category = 'unresolved'), 0) AS BIGINT) AS unresolved, CAST(coalesce(sum(words) FILTER (category = 'assigned_answer' AND eligible), 0) AS BIGINT) AS eligible FROM q GROUP BY 1)
SELECT event_id, raw AS raw_ceo_qa_words, assigned AS assigned_answer_words, unresolved AS unresolved_words, eligible AS eligible_answer_words, round(eligible / nullif(raw, 0)::DOUBLE, 9) AS raw_qa_word_share, round(eligible / nullif(assigned, 0)::DOUBLE, 9) AS answer_inclusion_coverage FROM s"""
)
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, C-17, A-19."""
    ceo = domain.units(spark, sf_dir).filter("section = 'Q&A'").select("event_id", "sequence_id", F.col("words").alias("word_count"), F.lit("").alias("kind"))
    block = F.format_string("%d_%d", "event_id", "sequence_id")
    owned = ceo.filter("sequence_id % 3 <> 0").select("event_id", "sequence_id", block.alias("block_id"))
    ledger = units.turn_categories(ceo, owned, ceo.filter("false").select("event_id", "sequence_id", F.lit("").alias("category")))
    eligible = owned.filter("sequence_id % 4 <> 2").select("block_id")
    out = units.word_coverage(ledger, eligible)
    return out.select("event_id", "raw_ceo_qa_words", "assigned_answer_words", "unresolved_words", "eligible_answer_words", F.round("raw_qa_word_share", 9).alias("raw_qa_word_share"), F.round("answer_inclusion_coverage", 9).alias("answer_inclusion_coverage"))


@query(
    f"""WITH {_RUNS}, n AS (SELECT event_id, count(*) AS b FROM bl GROUP BY 1), w AS (SELECT conv_id, role, turn, {_CLEAN.format(c="text")} AS t FROM conversations WHERE role <> 'user')
SELECT c.conv_id AS event_id, CASE WHEN pre AND qa AND b IS NOT NULL THEN 'exact_single_shared_speaker_key' ELSE 'review_or_no_shared_speaker_key' END AS identity_status,
       concat_ws(';', CASE WHEN NOT (pre AND qa) THEN 'BLOCK_AUDIT_EXCLUDE_NO_SAME_CEO' WHEN b IS NULL THEN 'BLOCK_AUDIT_REVIEW_NO_CEO_ANSWER_TO_ANALYST_QUESTION' END, CASE WHEN NOT (pre AND qa) THEN 'NO_SHARED_PRE_QA_CEO_LABEL' END) AS identity_flags,
       CASE WHEN pre AND qa THEN (SELECT coalesce(sum(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END), 0)::BIGINT FROM w WHERE w.conv_id = c.conv_id AND role = 'system') ELSE 0 END AS pre_ceo_word_count,
       CASE WHEN pre AND qa THEN (SELECT coalesce(sum(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END), 0)::BIGINT FROM w WHERE w.conv_id = c.conv_id AND role <> 'system') ELSE 0 END AS qa_ceo_word_count
FROM ({_CALLS_WITH}) c LEFT JOIN n ON n.event_id = c.conv_id"""
)
def presentation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-7, E-5."""
    turns, anchors, found = _blocks(spark, sf_dir)
    out = gate.presentation(turns, _identity(spark, sf_dir), episodes.event_audit(anchors, found))
    return out.select("event_id", "identity_status", "identity_flags", "pre_ceo_word_count", "qa_ceo_word_count")


@query(
    """WITH p AS (SELECT o_custkey AS turnover_id, bool_or(o_orderstatus = 'F') AS old, bool_or(o_orderstatus = 'O') AS new, count(*) FILTER (o_orderkey % 10 = 0) AS bad, max(o_orderdate) FILTER (o_orderstatus = 'F') AS l, min(o_orderdate) FILTER (o_orderstatus = 'O') AS f FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT turnover_id, CASE WHEN NOT (old AND new) THEN 'missing_or_invalid_old_new_sides' WHEN bad > 0 THEN 'unconfirmed_event_speaker' WHEN turnover_id % 9 = 0 THEN 'same_executive_on_both_turnover_sides' WHEN l >= f THEN 'mislabelled_or_overlapping_side_dates' ELSE '' END AS pair_review_reason,
       CASE WHEN NOT (old AND new) OR bad > 0 OR turnover_id % 9 = 0 OR l >= f THEN 'review_or_mismatch' ELSE 'confirmed_both_sides' END AS pair_validation_status FROM p"""
)
def pair_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-8, J-17."""
    o, old = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), F.col("o_orderstatus") == "F"
    status = F.when(F.col("o_orderkey") % 10 == 0, "other").otherwise("confirmed_external_ceo_shared_pre_qa")
    person = F.when(old | (F.col("o_custkey") % 9 == 0), 1).otherwise(2)
    rows = o.select(F.col("o_custkey").alias("turnover_id"), F.when(old, "old").otherwise("new").alias("turnover_side"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("event_date"), person.alias("expected_execid"), F.lit("Jane Roe").alias("expected_ceo_name"), status.alias("external_speaker_validation_status"))
    return gate.pair_validation(rows)


@query(
    f"""{_LANES}, s AS (SELECT gvkey, execid, gate AND pc >= 5 AND pq >= 5 AS ok FROM g), t AS (SELECT gvkey, execid AS o, lead(execid) OVER (PARTITION BY gvkey ORDER BY execid) AS n FROM g),
p AS (SELECT t.* FROM t JOIN s a ON a.gvkey = t.gvkey AND a.execid = o AND a.ok JOIN s b ON b.gvkey = t.gvkey AND b.execid = n AND b.ok WHERE o % 3 <> 0), m AS (SELECT gvkey, o AS execid FROM p UNION SELECT gvkey, n FROM p)
SELECT e AS event_id, gvkey, execid FROM c JOIN m USING (gvkey, execid) WHERE c.p"""
)
def lane_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-20: calls of the primary lane in turnovers that pass."""
    calls, support = _lanes(spark, sf_dir)
    order = Window.partitionBy("gvkey").orderBy("execid")
    pairs = support.select("gvkey", F.col("execid").alias("old_execid"), F.lit(1).alias("old_tenure_episode"), F.lead("execid").over(order).alias("new_execid"), F.lit(1).alias("new_tenure_episode"), (F.col("execid") % 3 != 0).alias("turnover_analysis_gate_pass"))
    one = lambda df: df.withColumn("tenure_episode", F.lit(1))
    return units.lane_members(one(calls), pairs, one(support), "primary").select("event_id", "gvkey", "execid")
