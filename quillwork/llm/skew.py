"""Joins in which one key may hold a large part of all rows, and joins that leave most rows where they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with over total / SHARES of all rows (and over LEAST) are frequent; there are fewer than SHARES of them.
SHARES = 1000
LEAST = 1000
ROWS_OF_TASK = 1 << 18
BITS_OF_KEY, MOST_BITS = 16, 1 << 29  # 64 MB at most
_CELL = 1 << 15  # bits in a value of bitmap_construct_agg


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) on ``key`` with ``table``, which has a row for each key and ``n``: its number of rows.

    Frequent keys are broadcast, which is fewer than SHARES rows whatever the size, so their rows stay where they are;
    the rest is shuffled, and no partition gets over total / SHARES rows of a key. ``n`` goes. Both sides are read
    twice: give written tables, or what is cheap to read.
    """
    columns = [c for c in table.columns if c not in (key, "n")]
    hot = F.col("n") > max(total // SHARES, LEAST)
    frequent = F.broadcast(table.filter(hot).select(key, *columns))
    many = rows.join(frequent, key)
    few = rows.join(frequent.select(key), key, "left_anti").join(table.filter(~hot).select(key, *columns), key, how)
    return many.unionByName(few)


def sized(table: DataFrame, rows: int) -> DataFrame:
    """``table``, which has narrow rows (numbers and short lists of them), ``rows`` at most, and ends with a shuffle, in
    as many partitions as it fills: a small table is one file and not one for each shuffle partition.

    Only the tasks after the shuffle become fewer, each of about ROWS_OF_TASK rows; a table that fills its partitions
    keeps them.
    """
    return table.coalesce(max(1, -(-rows // ROWS_OF_TASK)))


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def blocks(table: DataFrame, key: str, rows: int) -> Iterator[DataFrame]:
    """``table`` (of rows of a fixed width) in parts of about ``rows`` rows, each to be broadcast; split by hash of ``key``."""
    parts = max(1, -(-table.count() // max(1, rows)))
    for part in range(parts):
        yield F.broadcast(table if parts == 1 else table.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part))


def split_by_hash(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among those of ``keys``, rows whose hash is not).

    What is broadcast is a bit for each of the hash values modulo a power of two, BITS_OF_KEY times as many as there
    are keys and MOST_BITS at most, so the rows that can't meet a key are told without a shuffle at any size. Both
    parts read ``rows``: give a written table, or what is cheap to read; so must ``keys`` be.
    """
    bits = min(MOST_BITS, max(_CELL, 1 << (BITS_OF_KEY * keys.count()).bit_length()))
    place, cell, held = (unused(rows.columns, n) for n in ("__place", "__cell", "__bits"))
    at = keys.select(F.pmod(key_hash, F.lit(bits)).alias("p"))
    table = at.groupBy(F.expr(f"p div {_CELL}").alias(cell)).agg(F.bitmap_construct_agg(F.col("p") % _CELL).alias(held))
    placed = rows.withColumn(place, F.pmod(row_hash, F.lit(bits))).withColumn(cell, F.expr(f"`{place}` div {_CELL}"))
    byte = f"cast(conv(hex(substring(`{held}`, cast((`{place}` % {_CELL}) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(`{place}` % 8 as int)) & 1")
    marked = placed.join(F.broadcast(table), cell, "left").withColumn(place, F.coalesce(bit == 1, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(F.col(place)).select(*columns), marked.filter(~F.col(place)).select(*columns)
