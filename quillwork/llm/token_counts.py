"""Token counts by a forward pass over a trie of distinct pre-tokens: each shared prefix is scored once."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillwork.llm.arrow import texts
from quillwork.tables import spread

SPACE = "▁"
_LETTER = r"[^\W\d_¹²³]"
_OTHER = rf"(?:(?!{_LETTER})[^{SPACE}\n])"
_PRE_TOKEN = re.compile(rf"\n|{SPACE}*{_LETTER}+|{SPACE}*{_OTHER}+|{SPACE}+")
TABLE_CHARS = 8 << 20  # of the pre-tokens that a process keeps: some 1.2 million of usual length, 150 MB with their counts
LONG_CHARS = 256  # longer pre-tokens are scored each time and not kept
_HALF = 32  # both counts of a pre-token are one integer, so that a text's are one sum


@dataclass
class Vocabulary:
    """Pieces and their ranks in a BPE vocabulary with byte fallback; ``score`` is the unigram log weight of a rank."""

    rank: dict[str, int]
    longest: dict[str, int] = field(init=False)  # by the last two characters, of the pieces that end so
    score: dict[str, float] = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.longest = {}
        for piece in self.rank:
            if len(piece) > 1:
                self.longest[piece[-2:]] = max(len(piece), self.longest.get(piece[-2:], 1))
        self.score = {p: -math.log(2 + r) for p, r in self.rank.items()}
        self.unknown = min(self.score.values(), default=0.0) - 10.0


def load(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece BPE model file. Its merges follow its pieces' scores, the best first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.vocab_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
    order = sorted(ids, key=lambda k: (-model.get_score(k), k))
    return Vocabulary({model.id_to_piece(k): r for r, k in enumerate(order)})


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """Byte-pair encoding as defined: merge the adjacent pair of the best rank, the leftmost of equals, until none is left."""
    parts = list(text)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: (rank.get(parts[k] + parts[k + 1], math.inf), k))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class TrieScorer:
    """Forward states of pre-tokens in trie order.

    Sorted pre-tokens are the trie's leaves in preorder: the path to a pre-token shares its first nodes with the one
    before it, and only the rest is scored. A node holds, for its prefix, (a) the score and the number of pieces of
    its best unigram segmentation, and (b) the last piece and the number of pieces of its BPE encoding. For (b) the
    candidates are the same pieces that end at the node; the encoding of a prefix ends in the one that BPE leaves
    apart from the last piece of the encoding before it, which exactly one does.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.apart = lru_cache(1 << 19)(lambda a, b: merge(a + b, vocabulary.rank) == [a, b])
        self.whole = lru_cache(1 << 16)(lambda a: len(merge(a, vocabulary.rank)) == 1)

    def counts(self, pre_tokens: Iterable[str]) -> dict[str, tuple[int, int]]:
        """(BPE pieces, unigram pieces) of each distinct pre-token; a character that is no piece is its UTF-8 bytes."""
        rank, score, longest, unknown = self.v.rank, self.v.score, self.v.longest, self.v.unknown
        out: dict[str, tuple[int, int]] = {}
        best, pieces, last, merged = [0.0], [0], [""], [0]  # the states along the path; last is None after bytes
        before = ""
        for token in sorted(pre_tokens):
            shared, most = 0, min(len(token), len(before))
            while shared < most and token[shared] == before[shared]:
                shared += 1
            for stack in (best, pieces, last, merged):
                del stack[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top, n_top, tail, n_tail = -math.inf, 0, "", -1
                for start in range(max(0, end - longest.get(token[max(0, end - 2) : end], 1)), end):
                    piece = token[start:end]
                    if piece in rank:
                        s = best[start] + score[piece]
                        if s > top:
                            top, n_top = s, pieces[start] + 1
                        if n_tail < 0 and (end - start == 1 or self.whole(piece)) and (not last[start] or self.apart(last[start], piece)):
                            tail, n_tail = piece, merged[start] + 1
                if token[end - 1] not in rank:
                    size = len(token[end - 1].encode("utf-8", "surrogatepass"))
                    s = best[end - 1] + unknown
                    if s > top:
                        top, n_top = s, pieces[end - 1] + size
                    if n_tail < 0:
                        tail, n_tail = None, merged[end - 1] + size
                best.append(top)
                pieces.append(n_top)
                last.append(tail)
                merged.append(n_tail)
            out[token] = (merged[-1], pieces[-1])
            before = token
        return out


def pre_tokens(text: str) -> list[str]:
    """A text as the model sees it, with spaces as SPACE and one before the start, cut where no piece spans the cut:
    before each run of SPACE, around line breaks, and between letters and other characters."""
    return _PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def check(vocabulary: Vocabulary) -> Vocabulary:
    """Refuses a vocabulary with pieces that span the cuts of ``pre_tokens``."""
    if bad := [p for p in vocabulary.rank if _PRE_TOKEN.findall(p) != [p]]:
        raise ValueError(f"pieces span pre-tokens: {bad[:5]}")
    return vocabulary


class Table:
    """Counts of pre-tokens that a process has seen, of a bounded size: it is emptied when it would outgrow it."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.chars = 0

    def extend(self, scorer: TrieScorer, wanted: set[str]) -> dict[str, int]:
        """Counts of all that is ``wanted``; what is short is kept for the next call."""
        new = wanted.difference(self.counts)
        size = sum(len(t) for t in new if len(t) <= LONG_CHARS)
        if self.chars + size > TABLE_CHARS:
            self.counts, self.chars, new = {}, 0, wanted
            size = sum(len(t) for t in new if len(t) <= LONG_CHARS)
        found = {t: n << _HALF | m for t, (n, m) in scorer.counts(new).items()}
        long = {t: n for t, n in found.items() if len(t) > LONG_CHARS}
        if size > TABLE_CHARS:  # more than the table holds: for this call only
            return self.counts | found
        self.chars += size
        self.counts.update((t, n) for t, n in found.items() if t not in long)
        return self.counts | long if long else self.counts


_process: dict[int, tuple[TrieScorer, Table]] = {}


def process_state(key: int, vocabulary: Vocabulary) -> tuple[TrieScorer, Table]:
    """The scorer and table of this process, which its tasks share; those of another vocabulary go."""
    if key not in _process:
        _process.clear()
        _process[key] = TrieScorer(vocabulary), Table()
    return _process[key]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (of the model's own BPE encoding), n_unigram (pieces of the best unigram segmentation), n_pre_tokens.

    No row is shuffled: a task scores the distinct pre-tokens of a slice of texts at a time and keeps a table of them,
    of a bounded size, for the next. Null and empty texts have no token; a very long text, or pre-token, is read whole.
    Rows are counted one by one, so repeated rows and null ids change nothing; an empty table gives no rows; other
    columns are not read, whatever their names. ``path`` is read on the driver; the vocabulary goes to the executors,
    as large as the file and no larger with more data.
    """
    loaded = check(load(path))
    key = hash(tuple(loaded.rank))
    vocabulary = docs.sparkSession.sparkContext.broadcast(loaded)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, table = process_state(key, vocabulary.value)
        for batch in batches:
            columns: list[list[int]] = [[], [], []]
            for _, part in texts(batch.column(1), 1 << 20):
                cut = [pre_tokens((t or b"").decode("utf-8", "replace")) for t in part]
                counts = table.extend(scorer, set().union(*cut))
                for tokens in cut:
                    total = sum(map(counts.__getitem__, tokens))
                    columns[0].append(total >> _HALF)
                    columns[1].append(total & ((1 << _HALF) - 1))
                    columns[2].append(len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [id_col, "n_tokens", "n_unigram", "n_pre_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(apply, f"`{id_col}` {kind}, n_tokens long, n_unigram long, n_pre_tokens long")
