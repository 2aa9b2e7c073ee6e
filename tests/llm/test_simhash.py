from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import gray_index, simhash
from quillwork.llm.components import connected_components
from quillwork.llm.skew import ROWS_OF_TASK, sized
from quillwork.tables import table
from tests.llm.conftest import PROSE, documents


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, most):
    codes = list(codes)
    forest = gray_index.Forest(len(codes))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most:
                forest.join(i, j)
    roots = forest.roots()
    return {frozenset(c for c, r in zip(codes, roots, strict=True) if r == root) for root in set(roots.tolist())}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two three", "a b c d", "a b c d e", PROSE, "A\x0bB\x0cC d É e " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def ball(rng, n, spread):
    centre = rng.getrandbits(64)
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))) for _ in range(n)}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 9))
def test_index_links_like_all_pairs(seed, n, spread):
    rng = random.Random(seed)
    codes = np.array(sorted(ball(rng, n, spread) | ball(rng, n // 2, 3) | {0, 2**64 - 1}), np.uint64)
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    forest = gray_index.Forest(len(codes))
    gray_index.link_within(codes, 4, forest)
    roots = forest.roots()
    got = {frozenset(int(c) for c, r in zip(codes, roots, strict=True) if r == root) for root in set(roots.tolist())}
    assert got == brute_components([int(c) for c in codes], 4)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(gray_index.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@pytest.mark.parametrize(("chunk", "shared"), [(4096, None), (7, None), (50, 2), (4096, 4)])
def test_links_of_dense_groups(spark, monkeypatch, chunk, shared):
    """Groups of near copies that are split into chunks, and deeper choices of patterns, lose no link."""
    rng = random.Random(5)
    codes = sorted(ball(rng, 200, 3) | ball(rng, 120, 6) | {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**63})
    if shared:
        monkeypatch.setattr(simhash, "shared_blocks", lambda n, most: shared)
    rows = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fingerprint long")
    edges = simhash.links(rows, 4, chunk)
    found = connected_components(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(int(np.int64(r.node).view(np.uint64)))
    expected = {g for g in brute_components(codes, 4) if len(g) > 1}
    assert {frozenset(g) for g in groups.values()} == expected


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(5, 5), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


def expected_classes(rows):
    marks = [(i, brute_fingerprint(t)) for i, t in rows]
    classes = {c: g for g in brute_components({m for _, m in marks}, 4) for c in g}
    out = []
    for i, m in marks:
        ids = [j for j, x in marks if x in classes[m] and j is not None]
        out.append((i, f"{m:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def test_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == expected_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6]
    got = sorted((tuple(r) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == expected_classes([r[:2] for r in rows])
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd_rows):
    docs = documents(spark, odd_rows)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({i for i, c in classes.items() if i == c})


def test_stage_judges_rows_and_not_ids(spark):
    """A copy goes alone, whatever else has its id; texts that share an id stay apart; null ids come last."""
    a, b, c, d = (" ".join(f"{w}{k}" for w in PROSE.split()) for k in "abcd")
    rows = [(1, a), (7, a), (7, b), (8, c), (8, d), (8, d), (None, a), (None, "only here"), (None, "only here"), (None, None)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    whole = simhash.keep_representatives(docs, one_per_id=False)
    assert whole.columns == docs.columns
    expected = [(1, a), (7, b), (8, c), (8, d), (None, "only here"), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=repr) == sorted(expected, key=repr)
    once = [(r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()]
    assert len(once) == 5 and set(once) < set(expected) and sorted(i for i, _ in once if i) == [1, 7, 8]


def test_sized_keeps_rows_and_fills_partitions(spark):
    counted = spark.range(1000).repartition(8, "id")
    assert sized(counted, 1000).rdd.getNumPartitions() == sized(counted, 0).rdd.getNumPartitions() == 1
    assert sized(counted, ROWS_OF_TASK + 1).rdd.getNumPartitions() == 2
    assert sized(counted, 100 * ROWS_OF_TASK).rdd.getNumPartitions() == 8
    assert sized(counted, 1000).agg({"id": "sum"}).first()[0] == 499500
