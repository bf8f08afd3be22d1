"""Places in an order, at any size and skew: numbers within a key, and names that nobody else has.

A window over a key sorts all its rows in one task. Here rows are dealt by ranges of (key, order), so a key with many rows lies in several
partitions; a row's number is its place in its partition after the rows of its key in those before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.storage import cut, tasks


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str = "place") -> DataFrame:
    """rows with ``column``, 1, 2, 3 ... within ``keys`` (all rows, if there are none) in the given order.

    The ranges are written once, so that a lost executor doesn't deal rows anew.
    """
    keys = list(keys)
    dealt = cut(rows.repartitionByRange(tasks(rows), *(F.col(k).asc() for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a key and partition
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where("_before > 0").drop("_n")
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    joined = own.alias("r").join(F.broadcast(before).alias("b") if not keys else before.alias("b"), [*match, F.col("r._part") == F.col("b._part")], "left")
    return joined.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(column))


#: Characters kept for a number and its separator where a root is long.
RESERVE = 10


def unique_names(fresh: DataFrame, root: Column, taken: DataFrame, column: str, order: Sequence[str], separator: str = "-", most: int = 120, rounds: int = 60) -> DataFrame:
    """fresh with ``column``: its root where that is free, else the root and a number, no two the same and none of ``taken``.

    ``order`` tells rows apart. First the first row of each root takes it, if it is free. Then in each round the others ask for the next numbers of
    their root (of long roots, of what they begin with), each for another one; a name that is free goes to the first in order that asks for it, who gets none
    asks again with numbers that weren't asked for yet. Only names that two roots make in different ways (x with 2, and x-2) take another round.
    """
    names = list(order)
    told = F.struct(*names)
    cut_root = F.when(F.length(root) <= most, root).otherwise(F.regexp_replace(F.left(root, F.lit(most)), rf"\{separator}+$", ""))
    stem = F.when(F.length("_root") <= most - RESERVE, F.col("_root")).otherwise(F.regexp_replace(F.left("_root", F.lit(most - RESERVE)), rf"\{separator}+$", ""))
    rows = cut(fresh.withColumn("_root", cut_root).select("_root", *names).withColumn("_stem", stem))
    used = cut(taken.select(F.col(column).alias("_name")).where("_name is not null").distinct())
    first = rows.groupBy("_root").agg(F.min(told).alias("_first"))
    done = cut(first.select(F.col("_root").alias("_name"), "_first.*").join(used, "_name", "left_anti"))
    open_ = cut(rows.join(done.select(*names), names, "left_anti"))
    number = F.regexp_extract("_name", rf"\{separator}([1-9][0-9]{{0,8}})$", 1)
    asked = used.where(number != "").select(F.regexp_replace("_name", rf"\{separator}[0-9]+$", "").alias("_stem"), number.cast("long").alias("n"))
    asked = cut(asked.groupBy("_stem").agg(F.max("n").alias("_reached")).join(open_.select("_stem").distinct(), "_stem", "left_semi"))
    used = cut(used.union(done.select("_name")))
    for _ in range(rounds):
        if open_.isEmpty():
            return fresh.join(done.select(*names, F.col("_name").alias(column)), names)
        tried = numbered(open_, ["_stem"], [F.col(c) for c in names], "_place").join(asked, "_stem", "left")
        tried = tried.withColumn("_number", F.col("_place") + F.greatest(F.coalesce("_reached", F.lit(1)), F.lit(1)))
        tried = cut(tried.withColumn("_name", F.concat("_stem", F.lit(separator), F.col("_number").cast("string"))).join(used.withColumn("_used", F.lit(True)), "_name", "left"))
        free = tried.where("_used is null")
        won = cut(free.join(free.groupBy("_name").agg(F.min(told).alias("_first")), "_name").where(told == F.col("_first")).select("_name", *names))
        done = cut(done.union(won))
        open_ = cut(tried.join(won.select(*names), names, "left_anti").select("_root", *names, "_stem"))
        used = cut(used.union(won.select("_name")))
        asked = cut(tried.groupBy("_stem").agg(F.max("_number").alias("_reached")).join(open_.select("_stem").distinct(), "_stem", "left_semi"))
    raise RuntimeError(f"names did not settle in {rounds} rounds")
