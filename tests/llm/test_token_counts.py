from __future__ import annotations

import random

import pytest

from quillwork.llm import queries, token_counts
from quillwork.tables import table
from tests.llm.conftest import documents

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.check(token_counts.load(queries.tokenizer_path()))


def both(vocabulary, texts):
    scorer = token_counts.TrieScorer(vocabulary)
    cut = [token_counts.pre_tokens(t) for t in texts]
    counts = scorer.counts({x for c in cut for x in c})
    return [tuple(sum(counts[x][k] for x in c) for k in (0, 1)) for c in cut]


def random_texts(n):
    rng = random.Random(11)
    kinds = ["aabbcde  \n\t éｆ日本▁.,²³", "thesandio ", "THEthe'.,-%$ 0123", "lllloooo   "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for alphabet in kinds for _ in range(n)]


def test_counts_equal_the_library(model, vocabulary):
    texts = random_texts(400)
    assert [b for b, _ in both(vocabulary, texts)] == [len(model.encode(t)) for t in texts]


def test_unigram_counts_equal_a_viterbi_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    unigram = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0)] + list(vocabulary.score.items()), unk_id=0))
    texts = [t for t in random_texts(200) if all(c in vocabulary.rank for c in t.replace(" ", token_counts.SPACE))]
    shown = [token_counts.SPACE + t.replace(" ", token_counts.SPACE) if t else "" for t in texts]
    assert [u for _, u in both(vocabulary, texts)] == [len(unigram.encode(s).ids) for s in shown]


def test_prefixes_are_scored_once(vocabulary):
    scorer = token_counts.TrieScorer(vocabulary)
    together = scorer.counts(["abcabc", "abcab", "abd", "ab", "zz"])
    for t, n in together.items():
        assert scorer.counts([t]) == {t: n}


def test_query_against_the_library(spark, sf_dir, model):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}


def test_odd_rows(spark, model, odd_rows, monkeypatch):
    rows = [*odd_rows, (40, "x" * 100_000, "en", "a"), (41, " " * 5000, "en", "a")]
    got = token_counts.count_tokens(documents(spark, rows), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(model.encode(t)) if t else 0) for i, t, _, _ in rows)
    assert token_counts.count_tokens(documents(spark, rows).limit(0), queries.tokenizer_path()).count() == 0


def test_vocabularies_with_spanning_pieces_are_refused():
    with pytest.raises(ValueError, match="span"):
        token_counts.check(token_counts.Vocabulary({"a": 0, "b▁c": 1}))


def test_the_table_is_bounded(vocabulary, monkeypatch):
    """Counts don't depend on what is kept; a table never outgrows its bound, and long pre-tokens stay outside."""
    monkeypatch.setattr(token_counts, "TABLE_CHARS", 60)
    monkeypatch.setattr(token_counts, "LONG_CHARS", 20)
    scorer, table_ = token_counts.TrieScorer(vocabulary), token_counts.Table()
    rng = random.Random(5)
    for n in (3, 1, 8, 40, 2, 5):
        wanted = {"▁" + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30))) for _ in range(n)}
        found = table_.extend(scorer, wanted)
        alone = {t: a << 32 | b for t, (a, b) in scorer.counts(wanted).items()}
        assert {t: found[t] for t in wanted} == alone
        assert table_.chars == sum(map(len, table_.counts)) <= 60 and all(len(t) <= 20 for t in table_.counts)


def test_columns_of_any_name(spark, vocabulary):
    docs = spark.createDataFrame([("a", "some words", 1, 2)], "doc_id string, text string, n_tokens int, `n.x` int")
    assert token_counts.count_tokens(docs, queries.tokenizer_path()).first().n_tokens > 0
