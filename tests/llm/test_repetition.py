from __future__ import annotations

import random

import numpy as np
import pytest

from quillwork.llm import repetition
from quillwork.tables import table
from tests.llm.conftest import PROSE, documents


def brute_repeats(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_rules(text, limits):
    text = text or ""
    words = split(text)
    windows = lambda n: [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]

    def covered(n):
        w = windows(n)
        return len({k + d for k, x in enumerate(w) if w.count(x) > 1 for d in range(n)})

    lines = [x for x in text.split("\n") if split(x)]
    n, repeat = len(words), covered(3)
    failed = n < limits.min_words or 100 * repeat > 50 * n
    long = windows(limits.max_repeat + 1)
    kept = not failed and covered(limits.min_repeat) <= limits.max_fraction * n and len(set(long)) == len(long)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed, kept


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(40))] for _ in range(4)]
    texts[1] = texts[1] * 2
    flat = np.array([w for t in texts for w in t], np.int64)
    got = repetition.suffix_repeats(flat, np.repeat(np.arange(4), [len(t) for t in texts]))
    assert got.tolist() == [x for t in texts for x in brute_repeats(t)]


def test_rules_against_brute_force(spark, sf_dir):
    limits = repetition.Limits()
    docs = table(spark, sf_dir, "documents").filter("n_chars < 6000")  # brute force is quadratic
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) == brute_rules(r.text, limits)


def test_method_alone_fails_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    fresh = [word() for _ in range(400)]
    block = fresh[:100]
    rows = [(1, " ".join(fresh), "en", "a"), (2, " ".join(block + fresh[100:350] + block), "en", "a"), (3, " ".join(fresh[:210] + [word() for _ in range(900)] + fresh[:210]), "en", "a")]
    got = {r.doc_id: r for r in repetition.quality_rules(documents(spark, rows)).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].base_failed and not got[2].kept and got[2].covered_words == 200
    assert not got[3].base_failed and not got[3].kept and got[3].longest_repeat == 210


def test_odd_rows(spark, odd_rows):
    rows = [*odd_rows, (30, "a\n\n a\na \n a", "en", "a"), (31, "  x y", "en", "a"), (32, "é日 #*", "en", "a")]
    got = repetition.quality_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    short = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got if r.n_words < 1000)
    expected = sorted((i or 0, *brute_rules(t, repetition.Limits())) for i, t, _, _ in rows if len(t or "") < 10_000)
    assert short == expected
    assert repetition.quality_rules(documents(spark, rows).limit(0)).count() == 0


def test_one_word_text():
    found = repetition.judge([("x " * 5000).encode(), PROSE.encode()], repetition.Limits())
    assert found["longest_repeat"].tolist()[0] == 4999 and found["n_repeat_words"].tolist()[0] == 5000
