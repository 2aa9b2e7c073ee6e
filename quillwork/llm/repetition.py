"""Quality rules on repetition: a suffix array over words, its longest common prefixes and the repeats they delimit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillwork.llm.arrow import texts
from quillwork.tables import spread

BASE_WINDOW = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    """A text fails with over ``max_fraction`` of its words in repeats of ``min_repeat`` words or more, or with a repeat
    of over ``max_repeat`` words. The base rules fail texts under ``min_words`` words or with over half of the words
    in repeated windows of three."""

    min_words: int = 50
    min_repeat: int = 8
    max_fraction: float = 0.4
    max_repeat: int = 200


def suffix_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the length of the longest repeat that starts there: the greater LCP with a neighbour in the array.

    ``words``: word numbers of several texts, one after the other; ``text``: the text of each word, ascending. Suffixes
    end with their text. The array is sorted by prefix doubling; a suffix whose rank is unique is left out of later
    rounds, and as all of a class that is sorted again share a prefix, its new ranks give the LCP of those it parts.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    end = np.searchsorted(text, text, side="right")  # where the suffix's text ends
    _, kind, size = np.unique(text.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[kind]  # the first place of each class
    ranks = [rank]  # by the first 2^k words
    live = np.flatnonzero(np.bincount(rank)[rank] > 1)
    length = 1
    while len(live):
        beyond = live + length
        inside = beyond < end[live]
        tail = np.full(len(live), -1)
        tail[inside] = rank[beyond[inside]]
        order = np.lexsort((tail, rank[live]))
        head, tail, at = rank[live][order], tail[order], live[order]
        new_class = np.r_[True, head[1:] != head[:-1]]
        new_rank = new_class | np.r_[True, tail[1:] != tail[:-1]]
        first = np.maximum.accumulate(np.where(new_class, np.arange(len(at)), 0))
        start = np.maximum.accumulate(np.where(new_rank, np.arange(len(at)), 0))
        after = rank.copy()
        after[at] = head + (start - first)  # ranks are places, so those of a class follow its own
        parted = np.flatnonzero(new_rank & ~new_class)
        lcp = _common(ranks, at[parted - 1], at[parted], end, length)
        np.maximum.at(longest, at[parted - 1], lcp)
        np.maximum.at(longest, at[parted], lcp)
        rank = after
        ranks.append(rank)
        size = np.diff(np.r_[np.flatnonzero(new_rank), len(at)])
        live = np.sort(at[np.repeat(size > 1, size)])
        length *= 2
    return longest


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """LCP of suffixes that share their first ``length`` words but not twice as many."""
    common = np.full(len(a), length)
    for k in range(len(ranks) - 2, -1, -1):
        x, y = a + common, b + common
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        ok &= (np.minimum(end[a] - a, end[b] - b) - common) >= 1 << k
        common[ok] += 1 << k
    return common


def covered(repeats: np.ndarray, least: int, starts: np.ndarray) -> np.ndarray:
    """Words of each text in the union of the repeats of ``least`` words or more."""
    change = np.zeros(len(repeats) + 1, np.int64)
    first = np.flatnonzero(repeats >= least)
    change[first] += 1
    np.subtract.at(change, first + repeats[first], 1)
    return _per_text((np.cumsum(change[:-1]) > 0).astype(np.int64), starts)


def _per_text(values: np.ndarray, starts: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    out = np.zeros(len(starts) - 1, np.int64)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        out[some] = how.reduceat(values, starts[some])
    return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]  # strips \x20 and \x09-\x0D
    return len(lines) - len(set(lines))


def measure(part: list[bytes | None]) -> dict[str, np.ndarray]:
    """The base counts and the repeats of each text."""
    blobs = [t or b"" for t in part]
    words = [t.split() for t in blobs]
    n_words = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(n_words)]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    repeats = suffix_repeats(ids, np.repeat(np.arange(len(part)), n_words)) if len(ids) else np.zeros(0, np.int64)
    codes = np.frombuffer(b"".join(blobs), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in blobs])].astype(np.int64)
    in_words = ((codes & 0xC0) != 0x80) & ~_SPACE[codes]
    return {
        "n_words": n_words,
        "word_chars": _per_text(in_words.astype(np.int64), bounds),
        "n_symbols": _per_text(_SYMBOL[codes].astype(np.int64), bounds),
        "n_dup_lines": np.array([duplicate_lines(t) for t in blobs], np.int64),
        "n_repeat_words": covered(repeats, BASE_WINDOW, starts),
        "repeats": repeats,
        "starts": starts,
        "longest_repeat": _per_text(repeats, starts, np.maximum),
    }


def judge(part: list[bytes | None], limits: Limits) -> dict[str, np.ndarray]:
    found = measure(part)
    n = found["n_words"]
    found["covered_words"] = covered(found.pop("repeats"), limits.min_repeat, found.pop("starts"))
    found["base_failed"] = (n < limits.min_words) | (100 * found["n_repeat_words"] > 50 * n)
    found["kept"] = ~found["base_failed"] & (found["covered_words"] <= limits.max_fraction * n) & (found["longest_repeat"] <= limits.max_repeat)
    return found


_COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "covered_words": "long", "longest_repeat": "long",
}


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """id, the base counts and verdicts of every row, from its whole text.

    A null text has no words, as an empty one; both fail the base rules. Rows are judged one by one, so repeated rows
    and null ids change nothing; an empty table gives no rows; other columns are not read, whatever their names. A text
    is one suffix array whatever its length; short ones share an array.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column(1), 1 << 20):
                found = judge(part, limits or Limits())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(part)], *(pa.array(found[c]) for c in _COLUMNS)], [id_col, *_COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(apply, f"`{id_col}` {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
