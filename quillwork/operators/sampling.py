"""Deterministic samples: hash order, strata, caps, buckets, even spread, batches (L-2 to L-9)."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.ranges import sums_before
from quillwork.functions.text import first_reason


def stable_key(seed: int, lane: str | Column, value: Column) -> Column:
    """L-2: SHA-256 of seed, lane and value, joined by pipes: an order that is the same on every run."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(lane) if isinstance(lane, str) else lane, value.cast("string")), 256)


def hash_sample(df: DataFrame, seed: int, lane: str, key: str, n: int) -> DataFrame:
    """L-2: the ``n`` rows first in hash order, with sample_rank; Spark keeps ``n`` rows of each task only."""
    top = df.withColumn("sample_key", stable_key(seed, lane, F.col(key))).orderBy("sample_key", key).limit(n)
    return top.withColumn("sample_rank", F.row_number().over(Window.orderBy("sample_key", key)))


def allocate(counts: DataFrame, stratum: str, total: int, least: int, strata: int) -> DataFrame:
    """L-3: targets: ``least`` each, and the rest one by one in the order of rows (most first), then name, in closed form.

    ``counts`` has a row for each of ``strata`` strata with available; too few rows in one, or a ``total`` under the
    minimum, is an error.
    """
    rest = total - least * strata
    if rest < 0:
        raise ValueError(f"{total} is below the minimum of {least * strata}")
    place = F.row_number().over(Window.orderBy(F.desc("available"), stratum))
    target = F.lit(least + rest // strata) + F.when(place <= rest % strata, 1).otherwise(0)
    checked = F.when(F.col("available") >= least, target).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), F.col(stratum))))
    return counts.select(stratum, "available", checked.cast("long").alias("target"))


def capped_selection(rows: list[dict], targets: dict[str, int], seed: int, lane: str, caps: dict[str, int]) -> list[dict]:
    """L-4: walks the strata in the given order and each in hash order, and takes rows whose capped columns have room.

    Caps hold over all strata, so each choice depends on those before: this runs on the driver, on a candidate table
    that the protocol bounds. Too few for a target is an error.
    """
    used, taken, out = {c: Counter() for c in caps}, set(), []
    key = lambda r: hashlib.sha256(f"{seed}|{lane}|{r['event_id']}".encode()).hexdigest()
    for stratum, target in targets.items():
        room = target
        for row in sorted((r for r in rows if r["stratum"] == stratum), key=key):
            if room and row["event_id"] not in taken and all(used[c][row[c]] < cap for c, cap in caps.items()):
                taken.add(row["event_id"])
                for c in caps:
                    used[c][row[c]] += 1
                out.append(row)
                room -= 1
        if room:
            raise ValueError(f"{room} of {target} are missing for {stratum}")
    return out


def select_capped(df: DataFrame, targets: dict[str, int], seed: int, lane: str, caps: dict[str, int], batch: int = 1000) -> list[dict]:
    """L-4 as in ``capped_selection``, over a table of any size (event_id, stratum and the capped columns).

    A value whose cap is reached stays so, hence the rows that a walk skips are those that a filter on the full values
    and the taken events leaves out. The driver fetches the first ``batch`` of what the filter lets through, walks
    them, and goes on with the values that are full by then; each round takes a row at least. Full values are no more
    than rows taken.
    """
    used, taken, out = {c: Counter() for c in caps}, set(), []
    keyed = df.withColumn("__key", stable_key(seed, lane, F.col("event_id")))
    for stratum, target in targets.items():
        room = target
        while room:
            open_rows = keyed.filter(F.col("stratum") == stratum)
            for column, values in [("event_id", taken), *((c, {v for v, n in used[c].items() if n >= cap}) for c, cap in caps.items())]:
                known = [v for v in values if v is not None]
                if known:
                    open_rows = open_rows.filter(F.col(column).isNull() | ~F.col(column).isin(known))
                if None in values:
                    open_rows = open_rows.filter(F.col(column).isNotNull())
            found = [r.asDict() for r in open_rows.orderBy("__key", "event_id", *caps).limit(batch).collect()]
            before = room
            for row in found:
                if room and row["event_id"] not in taken and all(used[c][row[c]] < cap for c, cap in caps.items()):
                    taken.add(row["event_id"])
                    for c in caps:
                        used[c][row[c]] += 1
                    out.append({c: v for c, v in row.items() if c != "__key"})
                    room -= 1
            if room == before or (room and len(found) < batch):
                raise ValueError(f"{room} of {target} are missing for {stratum}")
    return out


def sampling_bucket(unit_type: Column, words: Column) -> Column:
    """L-5: length buckets of units."""
    pre = F.when(words < 100, "pre_short_lt100").otherwise("pre_long_ge100")
    return F.when(unit_type == "pre", pre).otherwise(first_reason((words < 50, "qa_short_lt50"), (words <= 200, "qa_medium_50_200"), default="qa_long_gt200"))


def choose_units(units: DataFrame, desired: list[str], seed: int, n: int, lane: str = "fresh_evaluation_unit") -> DataFrame:
    """L-5: ``n`` units of each event (event_id, unit_id, bucket): the first in hash order of each desired bucket, in
    their order, then the first of the rest in a second hash order."""
    order = F.array(*[F.lit(b) for b in desired])
    keyed = units.withColumns({
        "__b": F.array_position(order, F.col("bucket")),
        "__k1": stable_key(seed, F.concat(F.lit(f"{lane}|"), F.col("event_id").cast("string")), F.col("unit_id")),
        "__k2": stable_key(seed, F.concat(F.lit(f"{lane}_fill|"), F.col("event_id").cast("string")), F.col("unit_id")),
    })
    first = F.row_number().over(Window.partitionBy("event_id", "bucket").orderBy("__k1")) == 1
    lead = keyed.withColumn("__lead", first & (F.col("__b") > 0))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.when(F.col("__lead"), F.col("__b")).otherwise(F.lit(len(desired) + 1)), "__k2"))
    return lead.withColumn("unit_rank", rank).filter(F.col("unit_rank") <= n).drop("__b", "__k1", "__k2", "__lead")


def spread_indexes(n: int, k: int) -> list[int]:
    """L-6: ``k`` places evenly over 0..n-1, ends included, rounded half to even."""
    return [round(i * (n - 1) / max(1, k - 1)) for i in range(k)]


def spread_sample(df: DataFrame, event: str, key: str, n: int) -> DataFrame:
    """L-6: ``n`` rows over as many events as there are: one of each or of events spread evenly over all, then repeats.

    Rows are placed by counts within events and before events, so no task sorts all rows.
    """
    inner = Window.partitionBy(event).orderBy(key)
    placed = df.withColumn("__in", F.row_number().over(inner))
    per = sums_before(placed.groupBy(event).agg(F.max("__in").alias("__size")).filter(F.col(event).isNotNull()), event, __event=F.lit(1), __rest=F.col("__size") - 1)
    totals = per.agg(F.count("*").alias("events"), F.sum(F.col("__size") - 1).alias("rest")).first()
    groups, rest = totals.events, totals.rest or 0
    if n <= 0 or not groups:
        return df.limit(0).withColumn("sample_rank", F.lit(0))
    leads = spread_indexes(groups, n) if n <= groups else list(range(groups))
    extra = spread_indexes(rest, min(n - groups, rest)) if n > groups and rest else []
    picks = [(0, i, r) for r, i in enumerate(leads, start=1)] + [(1, i, r) for r, i in enumerate(extra, start=len(leads) + 1)]
    plan = df.sparkSession.createDataFrame(picks, "__again int, __place long, sample_rank int")
    joined = placed.join(per, event)
    again = (F.col("__in") > 1).cast("int")
    place = F.when(F.col("__in") == 1, F.col("__event")).otherwise(F.col("__rest") + F.col("__in") - 2).cast("long")
    wanted = joined.withColumns({"__again": again, "__place": place}).join(F.broadcast(plan), ["__again", "__place"])  # as many rows as n
    return wanted.select(*df.columns, "sample_rank")


def tier_quota_sample(df: DataFrame, tier: str, event: str, key: str, n: int) -> DataFrame:
    """L-7: 40 % review, 30 % usable with flag, the rest high, each spread; what a tier lacks is filled from all others."""
    quotas = {"review": round(n * 0.4), "usable_with_flag": round(n * 0.3)}
    quotas["high"] = n - sum(quotas.values())
    parts = [spread_sample(df.filter(F.col(tier) == t), event, key, q).withColumn("sample_part", F.lit(t)) for t, q in quotas.items()]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    left = min(n, df.count()) - chosen.count()
    if left > 0:
        chosen = chosen.unionByName(spread_sample(df.join(chosen.select(key), key, "left_anti"), event, key, left).withColumn("sample_part", F.lit("fill")))
    return chosen


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """L-9: rows with batch_id: consecutive ids in batches of ``size``, numbered without one task that sorts all.

    Ranges of the key are numbered by the counts of the ranges before them.
    """
    counts = sums_before(df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col(key).isNotNull()), key, __before=F.col("__n"))
    joined = df.withColumn("__in", F.row_number().over(Window.partitionBy(key).orderBy(key))).join(counts, key)
    return joined.withColumn("batch_id", F.floor((F.col("__before") + F.col("__in") - 1) / size)).select(*df.columns, "batch_id")
