from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from quillwork.llm import language_id
from quillwork.tables import table
from tests.llm.conftest import documents


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(held) > 20
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langs_of_held_out_rows_are_not_read(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hidden = docs.withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")))
    key = lambda df: sorted(tuple(r) for r in language_id.identify(df).collect())
    assert key(docs) == key(hidden)


def test_odd_rows(spark, sf_dir, odd_rows):
    train = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").collect()]
    moved = [(i + 1000, t, lang, s) for i, t, lang, s in train]
    got = language_id.identify(documents(spark, odd_rows + moved)).collect()
    assert len(got) == len(odd_rows) + len(moved)
    odd = [(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id < 1000]
    und = {i for i, lang, _ in odd if lang == language_id.UNDETERMINED}
    assert {2, 3, 4, 5} <= und
    assert [lang for i, lang, _ in odd if i == 1] == ["en", "en"]
    assert all(s == 0 for _, lang, s in odd if lang == language_id.UNDETERMINED)
    assert sum(r.held_out for r in got if r.doc_id is None) == 0


def test_nothing_to_learn_from(spark, odd_rows):
    unlabelled = documents(spark, [(i, t, None, s) for i, t, _, s in odd_rows])
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {language_id.UNDETERMINED}
    assert language_id.identify(unlabelled.limit(0)).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    junk = documents(spark, [(10_000, "12 34", "en", "a"), (10_001, None, "en", "a")]).select(*docs.columns)
    kept = language_id.keep_identified(docs.unionByName(junk))
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * docs.count()
    assert kept.filter("doc_id >= 10000").count() == 0


def test_families_are_disjoint():
    codes = [c for x in language_id.FAMILIES.values() for c in x.split()]
    assert len(codes) == len(set(codes))
    assert language_id.family_of("de") == language_id.family_of("en") != language_id.family_of("fr")
    assert language_id.family_of("xx") == "xx"


def test_predictions_equal_dense_dot_products(spark, sf_dir):
    """Every text's margins from a dense count of its grams, one by one; then families' and pairs' decisions as defined."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(docs), "text", "lang", "doc_id", 40, 2, 2, 1e-4, 17)
    assert len(model.families) > 1 and model.pairs
    rng = np.random.default_rng(3)
    model.weights = model.weights + rng.normal(0, 0.02, model.weights.shape).astype(np.float32)  # so that pairs disagree
    texts = [r.text.encode() for r in docs.select("text").limit(60).collect() if language_id.has_letter((r.text or "").encode())]

    def code(gram, four):
        n = int.from_bytes(gram, "little")
        n = (n ^ 0x9E3779B9) if four else n + 1
        return (n * 2654435761 % 2**32) >> (32 - language_id._HASH_BITS)

    def margins(text):
        folded = bytes(c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in b" " + text + b"  ")
        grams = [(folded[k : k + n], n == 4) for n in (3, 4) for k in range(len(folded) - n + 1)]
        counts = np.zeros(language_id._DIMENSIONS)
        total = 0
        for g, four in grams:
            if b"  " not in g:
                counts[code(g, four)] += 1
                total += 1
        return model.weights.astype(float) @ counts * (language_id._SCALE / max(total, 1)) + model.biases

    expected = []
    for t in texts:
        m = margins(t)
        family = model.families[int(np.argmax(m[: len(model.families)]))]
        members = [x for x in model.languages if language_id.family_of(x) == family]
        votes = dict.fromkeys(members, 0.0)
        for k, (a, b) in enumerate(model.pairs):
            if a in votes:
                x = m[len(model.families) + k]
                p = 1 / (1 + np.exp(-2 * x))
                votes[a] += (x >= 0) + p / len(members)
                votes[b] += (x < 0) + (1 - p) / len(members)
        expected.append(max(members, key=lambda x: votes[x]))
    assert model.predict(texts)[0] == expected and len(set(expected)) > 2


def test_stray_labels_make_no_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stray = docs.withColumn("lang", F.when(F.col("doc_id") % 40 == 3, F.concat(F.lit("junk-"), F.col("doc_id"))).otherwise(F.col("lang")))
    langs = {r.lang for r in docs.select("lang").distinct().collect()} | {language_id.UNDETERMINED}
    assert {r.lang_pred for r in language_id.identify(stray).select("lang_pred").distinct().collect()} <= langs


def test_very_long_text_and_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    long = docs.filter("lang = 'de'").limit(1).selectExpr("-1 AS doc_id", "repeat(concat(text, ' '), 3000) AS text", "CAST(NULL AS STRING) AS lang")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs.unionByName(long)).collect()}
    assert got[-1] == "de"
    assert language_id.identify(docs.limit(0)).count() == 0
