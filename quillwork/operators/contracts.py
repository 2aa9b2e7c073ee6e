"""Data contracts: violations are tables that must be empty (R-3, R-7, R-10, R-12, R-15, R-17, O-1 to O-3, O-8, P-13, J-7, J-9, J-13, U-2, SRC-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.ranges import sums_before


class ContractError(ValueError):
    """A table breaks its contract."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with up to three of the rows that should not be there."""
    found = violations.limit(3).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """R-7: keys that repeat, are null or blank, with their number of rows."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | blank)


def reconcile_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """O-1, J-13: each key of either side with its rows on both, and side = both, left_only or right_only."""
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "left_rows"), (right, "right_rows"))]
    joined = counts[0].join(counts[1], list(keys), "full_outer")
    side = F.when(F.col("right_rows").isNull(), "left_only").when(F.col("left_rows").isNull(), "right_only").otherwise("both")
    return joined.select(*keys, F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"), side.alias("side"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """R-3: rows of one side that the other lacks, repeats counted, with side."""
    columns = left.columns
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def fingerprint(*columns: str) -> Column:
    """P-13: a hash of the columns' JSON, nulls kept, so that neither order of keys nor separators blur."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def group_fingerprint(df: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """P-13: a hash of each group's row hashes in the given order."""
    rows = df.select(by, F.struct(F.col(order).alias("o"), fingerprint(*columns).alias("h")).alias("r"))
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), ""), 256).alias("payload_sha256"))


def resolve_aliases(df: DataFrame, keys: list[str], name: str, payload: list[str]) -> DataFrame:
    """O-8: a row for each key with its smallest name, all names and a status.

    One row: unique. Exactly two rows with two distinct non-blank names and one payload: exact_alias. All else is an
    error status, and keeps its rows' evidence; ``require_empty`` on those makes it fail closed.
    """
    blank = F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    grouped = df.withColumn("__p", fingerprint(*payload)).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.array_sort(F.collect_set(name)).alias("names"), F.count_if(blank).alias("blank_names"), F.count_distinct("__p").alias("payloads"), F.min("__p").alias("payload_sha256")
    )
    status = (
        F.when(F.col("rows") == 1, "unique")
        .when(F.col("payloads") > 1, "error_payload_differs")
        .when((F.col("rows") == 2) & (F.size("names") == 2) & (F.col("blank_names") == 0), "exact_alias")
        .otherwise("error_not_two_aliases")
    )
    return grouped.select(*keys, "rows", F.get("names", F.lit(0)).alias("kept_name"), F.array_join("names", ";").alias("alias_names"), status.alias("status"), "payload_sha256")


def merge_sources(*sources: DataFrame, keys: list[str]) -> DataFrame:
    """O-3: the union of sources with equal columns; an error if a key is in more than one of them."""
    numbered = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    union = numbered[0]
    for s in numbered[1:]:
        union = union.unionByName(s)
    overlap = union.groupBy(*keys).agg(F.count_distinct("__source").alias("sources")).filter("sources > 1")
    require_empty(overlap, "sources overlap")
    return union.drop("__source")


def exclusion_union(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """O-4: each source in order with its ids, and how many no earlier source has."""
    order = list(sources)
    union = None
    for k, (_, df) in enumerate(sources.items()):
        part = df.select(F.col(key).alias("id")).filter("id is not null").distinct().withColumn("k", F.lit(k))
        union = part if union is None else union.union(part)
    first = union.groupBy("id").agg(F.min("k").alias("first"))
    named = F.array(*[F.lit(n) for n in order])
    counted = union.join(first, "id").groupBy("k").agg(F.count("*").alias("ids"), F.count_if(F.col("k") == F.col("first")).alias("new_to_union"))
    return counted.select(F.get(named, F.col("k")).alias("source"), F.col("k").alias("source_order"), "ids", "new_to_union")


def exclusion_event_id(event_id: Column, *ids: Column) -> Column:
    """SRC-16: the event id, or the first run of digits after an underscore in the first other id there is."""
    other = F.coalesce(*[F.nullif(i, F.lit("")) for i in ids])
    return F.coalesce(F.nullif(F.trim(event_id), F.lit("")), F.nullif(F.regexp_extract(other, r"_(\d+)(?:_|\z)", 1), F.lit(""))).try_cast("long")


def fetch_audit_violations(audit: DataFrame) -> DataFrame:
    """R-15: audit rows whose status, notes or counts contradict each other, and repeated events."""
    notes = F.coalesce(F.col("fetch_notes"), F.lit(""))
    bad = (
        F.when((F.col("fetch_status") == "ok") & (notes != ""), "ok_with_notes")
        .when((F.col("fetch_status") == "review") & (notes != "duplicate_sequence_id"), "unknown_review_reason")
        .when(~F.col("fetch_status").isin("ok", "review") | F.col("fetch_status").isNull(), "unknown_status")
        .when((F.col("fetched_rows") < 0) | F.col("fetched_rows").isNull(), "bad_row_count")
    )
    repeated = audit.groupBy("event_id").count().filter("count > 1 or event_id is null").select("event_id", F.lit("repeated_event").alias("violation"))
    return audit.select("event_id", bad.alias("violation")).filter("violation is not null").unionByName(repeated)


def prefix_violations(old: DataFrame, new: DataFrame, place: str) -> DataFrame:
    """R-10: places (from 1) whose row in an earlier packet isn't the new packet's row of that place, and gaps in the
    new packet's places."""
    columns = [c for c in old.columns if c != place]
    rows = lambda df, n: df.select(F.col(place).alias("place"), fingerprint(*columns).alias(n))
    joined = rows(old, "old").join(rows(new, "new"), "place", "full_outer")
    last = new.agg(F.max(place).alias("last"), F.count("*").alias("rows"))
    changed = joined.filter("old is not null").select("place", F.when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed").alias("violation")).filter("violation is not null")
    return changed.unionByName(last.filter("last <> rows").select(F.col("last").cast("long").alias("place"), F.lit("gap").alias("violation")))


def overlay(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """R-10: a policy's columns under a prefix of their own, beside all others."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}" if c in columns else c) for c in df.columns])


def differing_cells(told: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """R-10: read-back: each cell (keys, column, told, again) in which two tables of unique keys differ; a row that one
    side lacks differs in all its cells."""
    columns = [c for c in told.columns if c not in keys]
    cells = lambda df, n: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(n)) for c in columns])).alias("c")).select(*keys, "c.*", F.lit(True).alias(f"has_{n}"))
    joined = cells(told, "told").join(cells(again, "again"), [*keys, "column"], "full_outer")
    return joined.filter(~(F.col("told").eqNullSafe(F.col("again")) & F.col("has_told").eqNullSafe(F.col("has_again")))).select(*keys, "column", "told", "again")


def label_store(mine: DataFrame, theirs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """R-12, R-17: two label files compared: the merged values and a status, same, only_mine, only_theirs or conflict.

    A conflict's values are null: it is for a person to resolve, and ``require_empty`` on conflicts fails an import.
    """
    sides = [df.select(F.col(key), F.struct(*values).alias(n)) for df, n in ((mine, "mine"), (theirs, "theirs"))]
    joined = sides[0].join(sides[1], key, "full_outer")
    status = F.when(F.col("theirs").isNull(), "only_mine").when(F.col("mine").isNull(), "only_theirs").when(F.col("mine").eqNullSafe(F.col("theirs")), "same").otherwise("conflict")
    merged = F.when(status != "conflict", F.coalesce("mine", "theirs"))
    return joined.select(key, *[merged[v].alias(v) for v in values], status.alias("status"))


def identity_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """U-2: parts of an execution identity (name, value) that are missing, unexpected or changed."""
    joined = expected.select("name", F.struct("value").alias("e")).join(found.select("name", F.struct("value").alias("f")), "name", "full_outer")
    drift = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("e").eqNullSafe(F.col("f")), "changed")
    return joined.select("name", drift.alias("drift")).filter("drift is not null")


def streams_by_event(gates: DataFrame, **streams: DataFrame) -> DataFrame:
    """J-9: each event with its rows in each stream, and what is wrong: a stream's event without a gate row, a repeated
    gate row, or a stream whose rows of the event don't stand together by ``position``.

    Streams have event_id and position; each is summed up by event before it is joined.
    """
    joined = gates.groupBy("event_id").agg(F.count("*").alias("gate_rows"))
    for name, df in streams.items():
        of = df.groupBy("event_id").agg(F.count("*").alias(f"{name}_rows"), (F.max("position") - F.min("position") + 1 != F.count("*")).alias(f"{name}_apart"))
        joined = joined.join(of, "event_id", "full_outer")
    apart = [F.when(F.col(f"{n}_apart"), f"{n}_rows_apart") for n in streams]
    why = F.concat_ws(";", F.when(F.col("gate_rows").isNull(), "no_gate_row"), F.when(F.col("gate_rows") > 1, "repeated_gate_row"), *apart)
    counts = [F.coalesce(f"{n}_rows", F.lit(0).cast("long")).alias(f"{n}_rows") for n in ("gate", *streams)]
    return joined.select("event_id", *counts, why.alias("violations"))


def event_spans(records: DataFrame) -> DataFrame:
    """SRC-14: the span of each event in a file of records (position, event_id, length): first offset, end and number of
    records, and whether nothing of another event stands between."""
    placed = sums_before(records, "position", offset=F.col("length"))
    spans = placed.groupBy("event_id").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("records"), F.sum("length").alias("bytes"))
    return spans.select("event_id", "begin", "end", "records", (F.col("end") - F.col("begin") == F.col("bytes")).alias("contiguous"))


def label_sets(a: Column, b: Column) -> Column:
    """O-2: struct (both, either): the intersection and the union of two sets of labels, sorted."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(F.array_union(a, b)).alias("either"))
