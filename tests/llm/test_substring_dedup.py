from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import substring_dedup
from tests.llm.conftest import documents


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_rolling_hash_forgets():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 256, 200).astype(np.uint8), rng.integers(1, 256, 200).astype(np.uint8)
    a[100:] = b[100:]
    n = substring_dedup.WINDOW_BYTES
    assert (substring_dedup.gear(a)[100 + n - 1 :] == substring_dedup.gear(b)[100 + n - 1 :]).all()
    step = substring_dedup._GEAR[a].astype(np.uint64)
    rolling = 0
    for k, g in enumerate(step.tolist()):
        rolling = (2 * rolling + g) % (1 << 16)
        if k >= 63:
            assert substring_dedup.gear(a)[k] == rolling * 0x9E37 % (1 << 16)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 80), st.integers(0, 120))
def test_cuts_resist_shifts(seed, before, after):
    rng = random.Random(seed)
    body = words(rng, 120)
    plain, shifted = (body, words(rng, before) + body + words(rng, after))
    cuts = substring_dedup.chunk_words([[w.encode() for w in plain], [w.encode() for w in shifted]])
    ends = lambda c, low, high: {int(x) for x in c if low <= x <= high}
    assert ends(cuts[0], 12, 105) == ends(cuts[1] - before, 12, 105)


def test_chunks_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [[w.encode() for w in words(rng, n)] for n in (0, 1, 5, 300, 0, 40)]
    together = substring_dedup.chunk_words(texts)
    for t, c in zip(texts, together, strict=True):
        assert substring_dedup.chunk_words([t])[0].tolist() == c.tolist()
        assert not t or (c[0] == 0 and (np.diff(np.r_[c, len(t)]) <= substring_dedup.MAX_WORDS).all())


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    passages = [words(rng, 51) for _ in range(30)]
    rows, clean = [], {}
    for i in range(200):
        own = words(rng, rng.randrange(0, 200))
        if i % 2:
            at = rng.randrange(len(own) + 1)
            own = own[:at] + passages[rng.randrange(30)] + own[at:]
        else:
            clean[i] = "  ".join(own) + "\n"
        rows.append((i, clean.get(i, " ".join(own)), "en", "a"))
    out = {r.doc_id: r for r in substring_dedup.deduplicate(documents(spark, rows)).collect()}
    assert all(out[i].text == t and out[i]._n_removed == 0 for i, t in clean.items())
    left = Counter(k for r in out.values() for k, p in enumerate(passages) if " ".join(p) in " ".join(r.text.split()))
    present = {k for _, t, _, _ in rows for k, p in enumerate(passages) if " ".join(p) in t}
    assert set(left) == present and set(left.values()) == {1}
    for k in left:  # the first copy stays
        assert min(i for i, t, _, _ in rows if " ".join(passages[k]) in t) == next(i for i, r in out.items() if " ".join(passages[k]) in r.text)


def test_copies_keep_the_first(spark):
    text = " ".join(words(random.Random(4), 300))
    rows = [(5, text, "en", "a"), (3, text, "en", "a"), (9, text, "en", "a"), (None, text, "en", "a"), (3, text, "en", "a")]
    out = sorted(((r.doc_id or 99, r.text) for r in substring_dedup.deduplicate(documents(spark, rows)).collect()))
    assert out == [(3, text), (3, text), (5, ""), (9, ""), (99, "")]


def test_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    out = substring_dedup.deduplicate(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert len(got) == len(odd_rows)
    assert sorted((r.doc_id or 0, r.text or "") for r in got if r.doc_id in (2, 3, 4, 5, 7)) == sorted((i, t or "") for i, t, _, _ in odd_rows if i in (2, 3, 4, 5, 7))
    assert sum(r.text is None for r in got) == 2
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0


def test_many_copies_over_batches(spark):
    """A chunk in every text of many partitions is found wherever its copies are."""
    rng = random.Random(8)
    line = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, 20)) + "\n" + line, "en", "a") for i in range(400)]
    out = substring_dedup.deduplicate(documents(spark, rows).repartition(23)).collect()
    assert sum(line in r.text for r in out) == 1
    assert all(r._n_removed >= 40 for r in out if r.doc_id != 0)


def test_passages_of_one_cycle_go(spark):
    """51 words that cycle through one to three go from the second document, whatever stands around them."""
    rng = random.Random(11)
    rows, own = [], {}
    for k in range(120):
        unit = words(rng, 1 + k % 3)
        passage = [unit[(k + j) % len(unit)] for j in range(51)]
        for i in (2 * k, 2 * k + 1):
            before, after = words(rng, rng.randrange(5, 80)), words(rng, rng.randrange(5, 80))
            own[i] = (before, after)
            rows.append((i, " ".join(before + passage + after), "en", "a"))
    out = {r.doc_id: r for r in substring_dedup.deduplicate(documents(spark, rows)).collect()}
    assert all(out[2 * k + 1]._n_removed >= 30 for k in range(120))
    for i, (before, after) in own.items():
        left = out[i].text.split()
        assert left[: len(before)] == before and left[-len(after) :] == after
        assert len(left) > len(before) + len(after) or i % 2


def test_cuts_in_a_cycle_do_not_depend_on_the_text_before():
    rng = random.Random(12)
    for k in range(300):
        unit = words(rng, 1 + k % 3)
        body = [unit[j % len(unit)] for j in range(60)]
        chunks = []
        for n in (0, rng.randrange(1, 60)):
            text = [w.encode() for w in words(rng, n) + body]
            first = substring_dedup.chunk_words([text])[0]
            bounds = [int(b) for b in first if n + 15 <= b <= n + 45]
            assert len(bounds) >= 4
            chunks.append({tuple(text[a:b]) for a, b in zip(bounds, bounds[1:])})
        assert chunks[0] == chunks[1]


def quadratic(rows):
    """What goes, found by comparing every chunk with every one before it: (row, text without the passages)."""
    texts = sorted({(i is None, i, t): t for i, t in rows}.items(), key=lambda x: (x[0][0], x[0][1] or 0))
    seen, gone = set(), {}
    for key, text in texts:
        w = text.split()
        first = [int(x) for x in substring_dedup.chunk_words([[x.encode() for x in w]])[0]] if w else []
        marks = []
        for a, b in zip(first, [*first[1:], len(w)]):
            marks.append((a, b, tuple(w[a:b]) in seen))
            seen.add(tuple(w[a:b]))
        kept, k = [], 0
        while k < len(marks):
            end = k
            while end < len(marks) and marks[end][2]:
                end += 1
            if end > k and marks[end - 1][1] - marks[k][0] < substring_dedup.MIN_RUN_WORDS or end == k:
                kept += w[marks[k][0] : marks[max(end - 1, k)][1]]
            k = max(end, k + 1)
        gone[key] = kept
    return [(i, " ".join(gone[(i is None, i, t)])) for i, t in rows]


def test_against_quadratic_search(spark):
    """Random texts that share passages of 10 to 90 words; texts are separate documents where ids repeat or are null."""
    rng = random.Random(21)
    shared = [words(rng, n) for n in range(10, 91, 2)]
    rows = []
    for k in range(300):
        parts = [rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randrange(30)) for _ in range(rng.randrange(6))]
        rows.append((None if k % 50 == 7 else k, " ".join(x for p in parts for x in p)))
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    plain = lambda found: sorted(((i is None, i, " ".join(t.split())) for i, t in found), key=repr)
    assert plain((r.doc_id, r.text) for r in got) == plain(quadratic(rows))
    assert sum(r._n_removed for r in got) > 2000


def test_recall_by_length(spark):
    """Share of the words of planted passages that go from their second copy; chance repeats don't."""
    rng = random.Random(22)
    rows, planted = [], {}
    for n in (25, 35, 50, 51, 80):
        for k in range(100):
            passage = words(rng, n)
            for second in (0, 1):
                i = len(rows)
                rows.append((i, " ".join(words(rng, rng.randrange(5, 90)) + passage + words(rng, rng.randrange(5, 90)))))
                if second:
                    planted[i] = n
    out = {r.doc_id: r._n_removed for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = {n: sum(out[i] > 0 for i, m in planted.items() if m == n) / 100 for n in (25, 35, 50, 51, 80)}
    assert caught[51] == caught[80] == 1 and caught[50] >= 0.99 and caught[35] >= 0.85, caught
    assert all(v == 0 for i, v in out.items() if i not in planted)


def test_ids_of_any_type_and_many_rows_without(spark):
    """String ids; 300 copies of one text without id, which are one document; other texts without id, which aren't."""
    rng = random.Random(23)
    line = words(rng, 80)
    rows = [(f"d{k:03}", " ".join(words(rng, 15) + line)) for k in range(40)] + [(None, " ".join(line))] * 300 + [(None, " ".join(words(rng, 60))) for _ in range(50)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id string, text string, __repeated int, __id int, __begin int, _n_words int, id int")
    out = substring_dedup.deduplicate(docs)
    assert out.columns == ["doc_id", "text", "__repeated", "__id", "__begin", "id", "_n_words", "_n_removed", "_n_passages", "_n_repeated"]
    got = out.collect()
    assert len(got) == len(rows) and {(r["__repeated"], r["__id"], r["__begin"], r.id) for r in got} == {(1, 2, 3, 5)}
    assert [r.doc_id for r in got if r.doc_id and r._n_removed == 0] == ["d000"]
    assert {r._n_removed for r in got if r.doc_id is None and r.text != "" and len(r.text.split()) == 60} == {0}
    assert sum(r.doc_id is None and r._n_removed > 0 for r in got) == 300
