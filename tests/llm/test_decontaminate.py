from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from quillwork import storage
from quillwork.llm import decontaminate
from quillwork.tables import table
from tests.llm.conftest import PROSE, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in wanted}:
            for k in range(len(w) - n + 1):
                if of := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= of
        named = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(named.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [decontaminate.BLOCK_ROWS, 60])
def test_against_brute_force(spark, sf_dir, rows):
    """60: terms, phrases and items are broadcast in many blocks."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert result(decontaminate.decontaminate(docs, items, block_rows=rows)) == expected
    assert any(r[-1] for r in expected)


def test_odd_rows_and_items(spark, odd_rows):
    items = [(1, "Quick BROWN fox"), (1, "Quick BROWN fox"), (2, None), (3, ""), (4, PROSE), (None, "seven wise owls"), (5, "ΑΣ'Α ΑΣ"), (12, "日本語のテキスト"), (30, "the the")]
    rows = odd_rows + [(20, "x ασ'α ας ΑΣ'Α ΑΣ y", "el", "d"), (21, "QUICK brown FOX, quick-brown fox", "en", "d"), (22, "the the the the", "en", "d"), (23, "Ärger İ K quick brown\x00fox", "de", "d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute([(i, t) for i, t, _, _ in rows], items)
    assert result(decontaminate.decontaminate(documents(spark, rows), bench)) == expected


def test_empty_tables(spark, odd_rows):
    docs = documents(spark, odd_rows)
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(docs, none).collect()
    assert len(got) == len(odd_rows)
    assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, PROSE)], none.schema)).count() == 0


def test_stage_drops_contaminated_rows_only(spark, odd_rows):
    docs = documents(spark, odd_rows)
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(odd_rows) - 3  # the two repeated rows and the one that adds a word


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x x beta x gamma", "en", "a"), (2, "gamma beta alpha", "en", "a"), (3, "alpha " + "x " * 30 + "beta gamma", "en", "a"), (4, "alpha beta", "en", "a"), (5, None, "en", "a")])
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, None)], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, slop=5)
    assert sorted((r.doc_id, r.item) for r in got.collect()) == [(1, 1), (2, 1)]


def test_string_ids(spark, odd_rows):
    items = [("mmlu/1", PROSE), ("mmlu/2", "quick brown fox"), (None, "seven wise owls")]
    rows = [(None if i is None else f"doc-{i}", t) for i, t, _, _ in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    expected = brute(rows, items)
    assert result(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"))) == expected
    none_hit = decontaminate.decontaminate(docs, spark.createDataFrame([("a/1", "no such words at all")], "item_id string, text string")).collect()
    assert {(r.n_hit, r.n_items) for r in none_hit} == {(0, 0)}


def test_capitals_beyond_ascii(spark):
    """Only A-Z are lowered: a phrase matches another spelling of their case, not of other letters'."""
    rows = [(1, "Ärger ÜBER alles"), (2, "ärger über alles"), (3, "ÄRGER über alles"), (4, "\u1c89x \u2c2fy \ua7c0z \U0001e900w Kilo"), (5, "İstanbul x"), (6, "ǅ ⓐ Ⓐ")]
    items = [(1, "Ärger ÜBER ALLES"), (2, "\u1c89X"), (3, "kilo"), (4, "İSTANBUL X"), (5, "ⓐ"), (6, "\U0001e900W")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.decontaminate(docs, bench)) == brute(rows, items)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, PROSE, 1, 2, 3), (2, "clean words", 4, 5, 6)], "doc_id long, text string, __id long, __of long, __place long")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, PROSE)], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean words", 4, 5, 6)]


def test_a_template_that_all_items_and_many_documents_hold(spark):
    """Ties of the rarest terms, one phrase of many items, one of many documents, and many copies without id."""
    template = "choose the best answer from the four options below and write only its letter"
    items = [(k, f"{template} {k}") for k in range(40)]
    rows = [(k if k % 3 else None, f"{template} for {k % 7}") for k in range(120)] + [(None, template)] * 50
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert result(decontaminate.decontaminate(docs, bench)) == expected == result(decontaminate.decontaminate(docs, bench, block_rows=7))


def test_proximity_against_brute_force(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    texts, asked = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()]
    counts, places = Counter(), {}
    for i, t in texts:
        for k, w in enumerate(words(t)):
            counts[w] += 1
            places.setdefault((i, w), []).append(k)
    expected = set()
    for item, t in asked:
        rare = sorted({w for w in words(t) if w in counts}, key=lambda w: (counts[w], w.encode()))[:3]
        for i, _ in texts if rare else ():
            for start in places.get((i, rare[0]), ()):
                if all(any(abs(k - start) <= 60 for k in places.get((i, w), ())) for w in rare):
                    expected.add((i, item, start))
    for rows in (decontaminate.BLOCK_ROWS, 9):
        got = decontaminate.proximity_matches(docs, items, slop=60, block_rows=rows).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 0


def test_no_step_runs_python(spark, sf_dir, monkeypatch):
    """The plan of the result, and of each table written on the way."""
    plans = []

    def spy(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.written(df, name, **options)

    def spy_parts(parts, name, **options):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in parts)
        return storage.written_in_parts(parts, name, **options)

    monkeypatch.setattr(decontaminate, "written", spy)
    monkeypatch.setattr(decontaminate, "written_in_parts", spy_parts)
    last = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)
    assert not any("text" in p for p in plans[1:] if "tokens" in p)  # texts are read once
