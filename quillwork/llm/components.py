"""Connected components of an edge table, in rounds that each write their edges to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.skew import join_counted, sized
from quillwork.storage import remove, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it can reach.

    Alternating large and small stars (Kiveris et al., 2014): each round links every node to the smallest of its
    neighbours, which at most doubles the edges of none and halves the depth, so the rounds grow with the logarithm of
    the longest chain. All grouping is by minimum, which Spark sums up before it shuffles; neighbours are never
    collected. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(ordered, "edges")
    edges_now, signature = now.count(), None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(sized(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), 2 * edges_now), "least")
        large = join_counted(both, least, "a", 2 * edges_now).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = written(sized(large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 2 * edges_now), "down")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        lowest = written(sized(lowest, 2 * edges_now), "lowest")
        linked = join_counted(down, lowest, "a", edges_now)
        small = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        after = written(sized(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 4 * edges_now), "edges")
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        for done in (now, least, down, lowest):
            remove(done)
        now, edges_now = after, row.n
        if (row.n, row.h) == signature:
            break
        signature = (row.n, row.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
