"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.arrow import texts
from quillwork.llm.components import connected_components
from quillwork.llm.gray_index import Forest, gray_rank, link_between, link_within
from quillwork.llm.skew import join_counted, sized, split_by_hash, unused
from quillwork.tables import spread
from quillwork.storage import written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = 1 << 16
DENSE = 4  # chunks in a level-1 node from which on it is refined


def fingerprint(text: bytes | None, shingle_words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the shingles, repeats included. No word: zero."""
    words = (text or b"").translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, seed)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip(ends, ends[shingle_words:])]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _STEP):
        part = np.array(hashes[k : k + _STEP], ">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """id and fingerprint (the 64 bits as a signed long) of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle_words) for _, part in texts(batch.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(apply, f"`{id_col}` {kind}, fingerprint long")


def masks(most: int, shared: int) -> list[np.uint64]:
    """Bit patterns of the top nodes: the 64 bits in most + shared blocks, and every choice of ``shared`` blocks.

    Two codes up to ``most`` bits apart differ in at most ``most`` blocks, so they agree on one of the patterns.
    """
    from itertools import combinations

    cuts = [round(64 * k / (most + shared)) for k in range(most + shared + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [np.uint64(sum(c)) for c in combinations(blocks, shared)]


def shared_blocks(codes: int, most: int, node_codes: int = 512) -> int:
    """The fewest shared blocks whose patterns spread ``codes`` to nodes of about ``node_codes``; all choices are exact."""
    for shared in range(1, 8):
        if codes <= node_codes << (64 * shared // (most + shared)):
            return shared
    return 8


def _keyed(codes: DataFrame, patterns: list[np.uint64]) -> DataFrame:
    """fingerprint and node (table, value) of every pattern."""
    values = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in patterns])
    return codes.select("fingerprint", F.posexplode(values).alias("table", "value")).select("fingerprint", F.struct("table", "value").alias("node"))


def _signed(mask: np.uint64) -> int:
    return int(np.uint64(mask).view(np.int64))


def refined(mask: np.uint64, most: int) -> list[np.uint64]:
    """``mask`` with each of most + 1 blocks of its other bits."""
    free = [b for b in range(64) if not int(mask) >> b & 1]
    cuts = [round(len(free) * k / (most + 1)) for k in range(most + 2)]
    return [np.uint64(int(mask) | sum(1 << b for b in free[x:y])) for x, y in zip(cuts, cuts[1:])]


def _refined(members: DataFrame, patterns: list[np.uint64], most: int) -> DataFrame:
    """Members of level-1 nodes under the nodes below them; their tables are numbered on from those of ``patterns``."""
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in refined(p, most)]) for p in patterns])
    each = members.select("fingerprint", F.col("node.table").alias("of"), F.posexplode(finer[F.col("node.table")]).alias("k", "mask"))
    table = (len(patterns) + F.col("of") * (most + 1) + F.col("k")).cast("int")
    return each.select("fingerprint", F.struct(table.alias("table"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("value")).alias("node"))


def links(distinct: DataFrame, most: int = 4, chunk: int = 4096) -> DataFrame:
    """Edges (a, b) that connect, directly or through others, all distinct fingerprints up to ``most`` bits apart.

    Level 1 of the index is dealt to the cluster: a node for each masked pattern (``masks``) and its value. Below it
    the fingerprints stand in Gray order under nodes of shared bits (``GrayIndex``), and pairs of nodes that differ in
    over ``most`` shared bits are pruned whole. A node gives a spanning forest of what it links, never all pairs. A
    level-1 node of over DENSE chunks of fingerprints is first replaced by the nodes of finer patterns below it. A node
    of over ``chunk`` fingerprints is split by hash into chunks, and each pair of chunks is a unit of work of its own,
    so no task holds more than two chunks at a time. Frequent nodes' members stay where they are until they are split.
    """
    chosen = masks(most, shared_blocks(distinct.count(), most))
    keyed = _keyed(distinct, chosen)
    total = keyed.count()
    sizes = written(sized(keyed.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), total), "nodes")
    dense = F.col("n") > DENSE * chunk
    members = join_counted(keyed, sizes.filter(~dense).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "node", total)
    if not sizes.filter(dense).isEmpty():
        # A pattern of a dense node is refined by each of most + 1 blocks of its other bits: two codes in reach agree on one.
        inside = written(join_counted(keyed, sizes.filter(dense).withColumn("dense", F.lit(True)), "node", total).drop("dense"), "dense-nodes")
        finer = _refined(inside, chosen, most)
        sizes = written(finer.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "finer-nodes")
        members = members.unionByName(join_counted(finer, sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "node", finer.count()))
    members = members.select("fingerprint", "chunks", F.col("node.table").alias("table"), F.col("node.value").alias("value"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    units = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = units.select("table", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fingerprint")
    dealt = units.repartition("table", "value", "lo", "hi").sortWithinPartitions("table", "value", "lo", "hi", "own")

    def link_unit(codes: np.ndarray, own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        forest = Forest(len(codes))
        parts = []
        order = np.lexsort((gray_rank(codes), own))
        codes, own = codes[order], own[order]
        cut = int(np.searchsorted(own, hi)) if lo != hi else len(codes)
        parts = [codes[:cut], codes[cut:]]
        if lo == hi:
            link_within(codes, most, forest)
        elif len(parts[0]) and len(parts[1]):
            link_between(parts[0], parts[1], most, forest, 0, cut)
        root = forest.roots()
        moved = np.flatnonzero(root != np.arange(len(codes)))
        return codes[moved], codes[root[moved]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the unit that may go on in the next batch
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            bounds = [0, *new.tolist(), len(cols[0])]
            out = [link_unit(cols[5][a:b].view(np.uint64), cols[4][a:b], cols[2][a], cols[3][a]) for a, b in zip(bounds[:-2], bounds[1:-1], strict=True)]
            held = tuple(c[bounds[-2] :].copy() for c in cols)
            yield from _edges(out)
        if held is not None and len(held[0]):
            yield from _edges([link_unit(held[5].view(np.uint64), held[4], held[2][0], held[3][0])])

    return dealt.mapInArrow(apply, "a long, b long")


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, most: int = 4) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row: the smallest id among all rows that it can reach.

    Rows reach each other over steps of ``most`` or fewer differing bits. Null and empty texts have fingerprint zero
    and link like any other. Equal fingerprints are one node, so copies, repeated rows and hot groups add no links. A
    null id counts as larger than any; a component of null ids only has a null component_id. Other columns are not
    read; an empty table gives no rows.
    """
    marks = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    rows = marks.count()
    distinct = written(sized(marks.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), rows), "distinct-fingerprints")
    nodes = written(connected_components(links(distinct.select("fingerprint"), most)).withColumnRenamed("node", "fingerprint"), "components")
    least = nodes.join(distinct, "fingerprint").groupBy("component").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n"))
    linked = nodes.count()
    named = join_counted(nodes, written(sized(least, linked), "classes"), "component", linked).select("fingerprint", "class_id")
    final = distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("class_id", "least_id").alias("component_id"), "n")
    joined = join_counted(marks, written(sized(final, rows), "fingerprint-classes"), "fingerprint", rows)
    return joined.select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", one_per_id: bool = True, **options) -> DataFrame:
    """One row of each component, the first by id (null last) and hash of the text; all columns stay.

    Rows that are no copy, by a bit of their hash, stay where they are. Of rows that repeat id and text, one stays. With ``one_per_id``, so does one of the representatives that share an
    id and differ in text (of null ids, all); without, each of them stays. Columns starting with __ are replaced.
    """
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__of", F.xxhash64(text_col))
    row = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__of").alias("of"))
    classes = near_duplicates(keyed.select(row.alias("__row"), text_col), id_col="__row", text_col=text_col, **options)
    gone = classes.filter(F.col("__row") != F.col("component_id")).select(F.col("__row.id").alias("__gone"), F.col("__row.of").alias("__gone_of")).distinct()
    gone = written(sized(gone, docs.count()), "gone")
    maybe, others = split_by_hash(keyed, F.xxhash64("__id", "__of"), gone, F.xxhash64("__gone", "__gone_of"))
    kept = others.unionByName(maybe.join(gone, F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__of") == F.col("__gone_of")), "left_anti"))
    repeated = keyed.groupBy("__id", "__of").count().filter("count > 1").select(F.col("__id").alias("__again"), F.col("__of").alias("__again_of"))
    if not repeated.isEmpty():
        kept = _once(kept, written(repeated, "repeated-rows"), F.col("__id").eqNullSafe(F.col("__again")) & (F.col("__of") == F.col("__again_of")), ["__id", "__of"])
    if one_per_id:
        repeated = keyed.filter("__id is not null").groupBy("__id").count().filter("count > 1").select(F.col("__id").alias("__again"))
        if not repeated.isEmpty():
            kept = _once(kept, written(repeated, "repeated-ids"), F.col("__id") == F.col("__again"), ["__id"])
    return kept.select(*docs.columns)


def _once(rows: DataFrame, repeated: DataFrame, on: Column, keys: list[str]) -> DataFrame:
    """``rows`` with one row of each key among those in ``repeated``, which is all that the aggregation handles."""
    return rows.join(repeated, on, "left_anti").unionByName(rows.join(repeated, on, "left_semi").dropDuplicates(keys))
