"""Accounting of runs: outcomes, funnels, health, coverage, rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.storage import cut

OUTCOMES = ("ambiguous", "created", "updated", "unchanged", "cancelled-not-created", "structural-skip", "excluded", "uncertain")
HEALTH = ("clean", "degraded", "review", "fatal")


def outcome(action: Column, skip: Column, eligibility: Column) -> Column:
    """What became of an observation; the first that holds, in this order."""
    out = F.when(action == "ambiguous", "ambiguous").when(action == "new", "created").when(action == "updated", "updated").when(action == "unchanged", "unchanged")
    out = out.when(skip == "cancelado", "cancelled-not-created").when(skip.isNotNull(), "structural-skip")
    return out.when(eligibility == "exclude", "excluded").when(eligibility == "uncertain", "uncertain").otherwise("structural-skip")


def tally(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def funnel(decisions: DataFrame, source: str) -> DataFrame:
    """One row a source: observations, and a column for each outcome. One aggregate, as outcomes are known."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in OUTCOMES]
    return decisions.groupBy(source).agg(F.count(F.lit(1)).alias("observations"), *counts)


def holds(funnels: DataFrame) -> DataFrame:
    """Whether outcomes sum to observations, over all sources."""
    total = sum(F.col(o.replace("-", "_")) for o in OUTCOMES)
    return funnels.agg(F.sum("observations").alias("observations"), F.sum(total).alias("outcomes"), F.count_if(total != F.col("observations")).alias("broken"))


def health(rows: DataFrame, source: str, findings: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Worst level of the findings (reason: condition on one row a source, level), their reasons, and whether a run may merge itself."""
    rank = F.greatest(F.lit(0), *(F.when(c, HEALTH.index(level)).otherwise(0) for c, level in findings.values()))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, reason) for reason, (c, _) in findings.items()))), ",")
    name = F.element_at(F.array(*map(F.lit, HEALTH)), rank + 1)
    return rows.select(source, name.alias("health"), reasons.alias("reasons"), (rank <= 1).alias("auto_merge"))


def coverage(first: Column, last: Column, start: str, end: str) -> Column:
    """How a published interval covers a window."""
    window = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.when(last < window[0], "stale").when((first <= window[0]) & (last >= window[1]), "complete").otherwise("partial")


def hydration(rows: DataFrame, source: str, attempted: Column, succeeded: Column) -> DataFrame:
    """Severe if none succeeded, or three or more failed and they are half or more."""
    out = rows.groupBy(source).agg(F.count_if(attempted).alias("attempted"), F.count_if(attempted & succeeded).alias("succeeded"))
    out = out.withColumn("failed", F.col("attempted") - F.col("succeeded"))
    severe = (F.col("attempted") > 0) & ((F.col("succeeded") == 0) | ((F.col("failed") >= 3) & (2 * F.col("failed") >= F.col("attempted"))))
    return out.withColumn("severe", severe)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Places by an order: rows are dealt out by ranges of it, put in order there, and each range begins after the rows of those before."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")  # over parts, not rows
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_within", within).join(parts.select("_part", before), "_part").withColumn("place", (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_before", "_within")


def quantiles(rows: DataFrame, key: str, value: str, shares: Mapping[str, float], ranges: int = 1024) -> DataFrame:
    """(key, one column a share): exact quantiles, interpolated between neighbours.

    Values are counted, then ranges of them; a key's values are put in order only within the ranges that hold the places asked for.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(key).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("n").alias("total"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * ranges), F.lit(ranges - 1))).otherwise(0)
    placed = counts.join(ends, key).withColumn("r", at.cast("int"))
    sums = placed.groupBy(key, "r", "total").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy(key).orderBy("r")) - F.col("held"))
    wanted = F.lit(False)
    for share in shares.values():
        place = (F.col("total") - 1) * share
        for p in (F.floor(place), F.ceil(place)):
            wanted = wanted | ((p >= F.col("before")) & (p < F.col("before") + F.col("held")))
    near = placed.join(sums.where(wanted).select(key, "r", "before"), [key, "r"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "r").orderBy("v"))
    near = near.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n"))
    here = lambda p: F.max(F.when((p >= F.col("from")) & (p < F.col("to")), F.col("v")))
    out = near.groupBy(key, "total").agg(*(here(rounded((F.col("total") - 1) * share)).alias(f"{name}_{side}") for name, share in shares.items() for side, rounded in (("low", F.floor), ("high", F.ceil))))
    between = lambda name, share: F.col(f"{name}_low") + ((F.col("total") - 1) * share - F.floor((F.col("total") - 1) * share)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return out.select(key, *(between(name, share).alias(name) for name, share in shares.items()))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    return rows.groupBy(expected, actual).agg(F.count(F.lit(1)).alias("n"))


def corroboration(rows: DataFrame, group: str, source: str) -> DataFrame:
    """In each group of several: sources beyond the first corroborate, repeats of a source are duplicates."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"))
    return out.where("n > 1").select(group, "n", (F.col("sources") - 1).alias("corroborations"), (F.col("n") - F.col("sources")).alias("duplicates"))


def fingerprint(date: str) -> Column:
    """A hash of the set of days that a group covers."""
    return F.md5(F.array_join(F.sort_array(F.collect_set(F.date_format(date, "yyyy-MM-dd"))), ","))


def discards(rows: DataFrame, source: str, reason: str = "discard") -> DataFrame:
    """(source, reason, n): how many rows of a source can't be used, and why."""
    return rows.where(F.col(reason).isNotNull()).groupBy(source, reason).agg(F.count(F.lit(1)).alias("n"))


def request_stats(requests: DataFrame, source: str, failed: Column, took: str) -> DataFrame:
    """(source, requests, failed, slowest, failure_rate) of a source's requests."""
    out = requests.groupBy(source).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failed"), F.max(took).alias("slowest"))
    return out.withColumn("failure_rate", F.col("failed") / F.col("requests"))
