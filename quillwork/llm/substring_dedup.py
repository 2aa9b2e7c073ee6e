"""Substring deduplication by content-defined chunks: cut where a gear rolling hash is lowest, keep each chunk once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillwork.llm.arrow import texts
from quillwork.llm.skew import split_by_hash, unused
from quillwork.tables import spread
from quillwork.storage import written

WINDOW_BYTES = 16
RADIUS_WORDS = 3
RUN_WORDS = 2 * RADIUS_WORDS  # a multiple of every cycle of RADIUS_WORDS words or fewer
MAX_WORDS = 24
MIN_RUN_WORDS = 20


def _gear_table() -> np.ndarray:
    """A 16-bit value for each byte, from a linear congruence; 0 for the byte that separates texts."""
    table, state = np.zeros(256, np.uint16), 0x2545F491
    for byte in range(1, 256):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        table[byte] = state >> 16
    return table


_GEAR = _gear_table()


def gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash h(i) = 2 h(i-1) + gear(byte i) modulo 2^16, which forgets all but 16 bytes, at every offset."""
    h = _GEAR[codes]
    span = 1
    while span < WINDOW_BYTES:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint16(span)
        h = h + shifted
        span *= 2
    return h * np.uint16(0x9E37)


def chunk_words(part: list[list[bytes]]) -> list[np.ndarray]:
    """For each text, given as words, the number of its first word in each chunk.

    A chunk ends after a word at whose end the gear hash is lowest among the RADIUS_WORDS words on either side, so cuts
    depend on nearby text only and an insertion moves those next to it at most. Of equals that follow each other
    within RADIUS_WORDS, as in a run that repeats a cycle of one to three words, the first counts and then every one at
    a multiple of RUN_WORDS words, so that the chunks of such a run are alike wherever it begins. Where no cut is
    within RUN_WORDS words, a hash that is lower than its two neighbours is one. A chunk that is still over MAX_WORDS
    words is cut every MAX_WORDS words.
    """
    blob = (b"\0" * WINDOW_BYTES).join(b" ".join(ws) for ws in part)
    hashes = gear(np.frombuffer(blob, np.uint8)) if blob else np.zeros(0, np.uint16)
    out, base = [], 0
    for ws in part:
        if not ws:
            base += WINDOW_BYTES
            out.append(np.zeros(0, np.int64))
            continue
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        low = hashes[base + ends - 2]
        base += int(ends[-1]) - 1 + WINDOW_BYTES
        cut = np.ones(len(ws), bool)
        for k in range(1, min(RADIUS_WORDS, len(ws) - 1) + 1):
            cut[k:] &= low[k:] <= low[:-k]
            cut[:-k] &= low[:-k] <= low[k:]
        at = np.flatnonzero(cut)
        head = np.r_[True, (np.diff(at) > RADIUS_WORDS) | (low[at[1:]] != low[at[:-1]])]
        at = at[(at - np.maximum.accumulate(np.where(head, at, 0))) % RUN_WORDS == 0]
        weak = np.flatnonzero(np.r_[False, (low[1:-1] < low[:-2]) & (low[1:-1] <= low[2:]), False]) if len(ws) > 2 else at[:0]
        near = np.r_[-len(ws) - RUN_WORDS, at, 2 * len(ws) + RUN_WORDS]
        after = np.searchsorted(near, weak)
        weak = weak[(near[after] - weak > RUN_WORDS) & (weak - near[after - 1] > RUN_WORDS)]
        at = np.union1d(at, weak)
        first = np.r_[0, at[at < len(ws) - 1] + 1]
        size = np.diff(np.r_[first, len(ws)])
        if size.max() > MAX_WORDS:
            pieces = -(-size // MAX_WORDS)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + k * MAX_WORDS
        out.append(first)
    return out


def _chunks(part: list[bytes | None]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(row, words, first words of the chunks) of each text."""
    words = [(t or b"").split() for t in part]
    yield from zip(range(len(part)), words, chunk_words(words), strict=True)


def _digests(words: list[bytes], first: np.ndarray) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    bounds = [*first.tolist(), len(words)]
    return [digest(b" ".join(words[a:b])) for a, b in zip(bounds, bounds[1:])]


def _codes(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal ids, in their order; the largest for null."""
    if pa.types.is_integer(ids.type):
        values = pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        valid = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
    else:
        valid = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
        values = np.array([b"" if x is None else str(x).encode() for x in ids.to_pylist()], object)
    _, code = np.unique(values, return_inverse=True)
    return np.where(valid, code, len(values))


def _later(digest: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of the sorted chunks stand at another place than the first of their digest."""
    first = np.maximum.accumulate(np.where(np.r_[True, digest[1:] != digest[:-1]], np.arange(len(digest)), 0))
    return np.any([p != p[first] for p in place], axis=0)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, of (hash of the text), first (number of the first word) and size (in words) of every chunk whose digest
    another chunk before it has, by id (null last), of and first.

    A chunk that is already second within its batch is known to repeat; it goes to a partition picked by its place, so
    that a frequent chunk sends a row for each batch, and not for each document, to the partition of its digest.
    """
    places = ["key", "id", "of", "first", "size", "known"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _codes(batch.column(0)), []
            for begin, part in texts(batch.column(2)):
                for row, words, cuts in _chunks(part):
                    if len(words):
                        found.append((begin + row, np.array(_digests(words, cuts), np.uint64).view(np.int64), cuts, np.diff(np.r_[cuts, len(words)])))
            if not found:
                continue
            row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            digest, first, size = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
            of = batch.column(1).to_numpy()[row]
            order = np.lexsort((first, of, ids[row], digest))
            row, of, digest, first, size = (c[order] for c in (row, of, digest, first, size))
            later = _later(digest, ids[row], of, first)
            key = np.where(later, of * np.int64(2654435761) + first, digest)
            columns = [pa.array(key), batch.column(0).take(pa.array(row)), pa.array(of), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(later)]
            yield pa.RecordBatch.from_arrays(columns, places)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None  # the first row of the digest that the batch before ended in
        for batch in batches:
            unknown = batch.filter(pa.compute.invert(batch.column(5)))
            found = [batch.filter(batch.column(5)).select(places[1:5])]
            if len(unknown):
                if begun is not None:
                    unknown = pa.concat_batches([begun, unknown])
                digest = unknown.column(0).to_numpy()
                again = _later(digest, _codes(unknown.column(1)), unknown.column(2).to_numpy(), unknown.column(3).to_numpy())
                found.append(unknown.filter(pa.array(again)).select(places[1:5]))
                last = int(np.searchsorted(digest[::-1] != digest[-1], True))
                begun = unknown.slice(len(unknown) - last, 1)
            yield from found

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = spread(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("of"), F.col(text_col).alias("text"))).mapInArrow(apply, f"key long, id {kind}, of long, first int, size short, known boolean")
    dealt = pieces.repartition("key").sortWithinPartitions("known", "key", F.col("id").asc_nulls_last(), "of", "first")
    return dealt.mapInArrow(repeats, f"id {kind}, of long, first int, size short")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """id, of, and the passages of each document that has any: lists of first word, end and number of chunks.

    A passage is a run of repeated chunks of ``min_run_words`` words in all. What is gathered in a row are the chunks of
    one document, which is told by id and hash of its text: rows without id, or of one id, are so many documents.
    """
    rows = repeated_chunks(docs, id_col, text_col)
    listed = rows.groupBy("id", "of").agg(F.collect_set(F.struct("first", "size")).alias("chunks")).filter("size(chunks) > 0").select("id", "of", F.sort_array("chunks").alias("chunks"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy())
            flat = batch.column(2).flatten()
            first, size = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            kept, out = [], []
            for row, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                f, n = first[a:b], size[a:b]
                head = np.flatnonzero(np.r_[True, f[1:] != f[:-1] + n[:-1]])
                words = np.add.reduceat(n, head)
                many = words >= min_run_words
                if many.any():
                    kept.append(row)
                    chunks = np.diff(np.r_[head, len(f)])
                    out.append([f[head][many], (f[head] + words)[many], chunks[many]])
            columns = [pa.array([[int(x) for x in o[k]] for o in out], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())), *columns], ["id", "of", "begin", "end", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return listed.mapInArrow(apply, f"id {kind}, of long, begin array<int>, end array<int>, chunks array<int>")


def _spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def cut_runs(text: bytes, begin: list[int], end: list[int]) -> bytes:
    """The text without the words of the passages, and the space after them."""
    starts = np.r_[_spans(text)[0], len(text)]
    kept, at = [], 0
    for a, b in zip(begin, end, strict=True):
        kept.append(text[at : starts[a]])
        at = int(starts[b])
    return b"".join([*kept, text[at:]])


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """All columns of ``docs``, with the text without repeated passages, and _n_words, _n_removed, _n_passages,
    _n_repeated (chunks in the passages that went).

    A chunk repeats if an earlier one (by id, null last, then text and position) has its digest. Consecutive repeated
    chunks of ``min_run_words`` words in all are a repeated passage, and go with the space after them; shorter runs are
    chance and stay. The first copy of each passage stays whole, but for what repeats inside it (a run of one cycle
    keeps its first chunks). Chunks are of whole texts, however long; words are compared exactly, the space between
    them is not. Null texts stay null, empty ones empty; an empty table gives no rows. Ids have any type; rows with the
    same id and text count as one document and get the same answer; null ids are one document for each text. Columns
    named like the four new ones are replaced; no other name clashes.

    Only rows that may have a passage, by a bit of their hash, are moved to meet the list.
    """
    new = ("_n_words", "_n_removed", "_n_passages", "_n_repeated")
    docs = docs.drop(*new)
    columns = docs.columns
    gone = written(repeated_passages(docs, id_col, text_col, min_run_words), "passages")
    mark = {n: unused(columns, f"__{n}") for n in ("id", "of", "begin", "end", "chunks")}
    gone = gone.select(*[F.col(n).alias(m) for n, m in mark.items()])
    own = [F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            begins, ends, chunks = (batch.column(len(columns) + k) for k in range(3))
            for at, part in texts(batch.column(columns.index(text_col))):
                for row, text in enumerate(part, at):
                    n = len((text or b"").split())
                    if not begins[row].is_valid:
                        values = (text, n, 0, 0, 0)
                    else:
                        a, b = begins[row].as_py(), ends[row].as_py()
                        values = (cut_runs(text, a, b), n, sum(b) - sum(a), len(a), sum(chunks[row].as_py()))
                    for to, value in zip(out, values, strict=True):
                        to.append(value)
            arrays = batch.columns[: len(columns)]
            arrays[columns.index(text_col)] = pa.array(out[0], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in out[1:])], [*columns, *new])

    schema = StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in new)])
    maybe, others = split_by_hash(docs, F.xxhash64(*own), gone, F.xxhash64(mark["id"], mark["of"]))
    met = maybe.join(gone, own[0].eqNullSafe(F.col(mark["id"])) & (own[1] == F.col(mark["of"])), "left")
    lists = [mark[n] for n in ("begin", "end", "chunks")]
    none = [F.lit(None).cast("array<int>").alias(m) for m in lists]
    every = met.select(*[F.col(f"`{c}`") for c in columns], *lists).unionByName(others.select("*", *none))
    return every.mapInArrow(apply, schema)
