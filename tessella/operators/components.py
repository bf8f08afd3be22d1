"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.storage import cut

#: Edges up to which the table of minima is broadcast (16 bytes each).
BROADCAST_EDGES = 200_000
#: Edges of a task.
ROWS_A_TASK = 50_000


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, settled, and how many they are, their smaller ends' sum and a hash of them all."""
    edges = cut(edges)
    row = edges.agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("sum"), F.bit_xor(F.xxhash64("a", "b")).alias("hash")).first()
    return edges.coalesce(1 + row["rows"] // ROWS_A_TASK), tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id that is not the smallest of its component; ``edges`` has long a and b.

    Each round points neighbours at the smallest id near them, with one grouped minimum and one
    join on it a step, so a hub never gathers in one place; the number of rounds grows with
    the logarithm of the components' size. Every round is written to the checkpoint folder.
    """
    now, state = _state(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    for _ in range(rounds):
        if not state[0]:
            break
        sized = F.broadcast if state[0] <= BROADCAST_EDGES else lambda df: df
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(sized(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = state
        now, state = _state(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
