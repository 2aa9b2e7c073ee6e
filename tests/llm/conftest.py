from __future__ import annotations

import pytest

# Columns whose names the operators use themselves.
CLASHING = "lang_pred string, score double, held_out boolean, fingerprint string, component_id long, key long, id long, of long, term long, pos int, w string, n long, places string, copy int, rate double, node long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def documents(spark, rows):
    """documents of (doc_id, text, lang, source), with columns that clash."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *([None] * 16)) for i, t, lang, s in rows], SCHEMA)


PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak and a grey cat sleeps near the warm stone wall of the garden"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, one id with two texts, no letters, a very long text."""
    long = " ".join(f"{w}{k % 977}" for k, w in enumerate(PROSE.split() * 4000))
    rows = [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"), (5, "12345 --- !!", "en", "b"), (None, PROSE + " indeed", "en", None)]
    return rows + [(None, None, None, None), (6, long, "en", "c"), (7, "Erste Zeile", "de", "c"), (7, "ganz anderer Text", "de", "c"), (8, "日本語のテキスト", None, "c"), (9, "<|im_start|> x", "en", "c")]
