"""Stateful event logic over tables: rate windows, streaks, debounce, state changes. tessella.streaming has it over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Each event with how many of its key fall in the window that ends with it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_at", at).withColumn("in_window", F.count(F.lit(1)).over(window)).drop("_at")


def streaks(events: DataFrame, key: str, order: list[str], bad: Column, least: int = 4) -> DataFrame:
    """(key, opened_at, length): runs of ``least`` or more bad events of a key in a row."""
    window = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_bad", bad).withColumn("_run", F.count_if(~F.col("_bad")).over(window))
    runs = marked.where("_bad").groupBy(key, "_run").agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("opened_at"))
    return runs.where(F.col("length") >= least).select(key, "opened_at", "length")


def debounced(events: DataFrame, key: str, order: list[str], value: str, seconds: float = 0.4) -> DataFrame:
    """Events followed by quiet, whose value is not empty and not what the key last emitted."""
    window = Window.partitionBy(key).orderBy(*order)
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    quiet = events.withColumn("_gap", F.lead(at).over(window) - at).where(F.col("_gap").isNull() | (F.col("_gap") >= int(seconds * 1_000_000)))
    said = quiet.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).withColumn("_last", F.lag(value).over(window))
    return said.where(~F.col("_last").eqNullSafe(F.col(value))).drop("_gap", "_last")


def once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key, by one grouped minimum."""
    first = F.min_by(F.struct(*events.columns), F.struct(*order))
    return events.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


def changes(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Events whose state is not the key's state before, with that."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state)))


def host_circuit(events: DataFrame, host: str, ts: str, url: str, bad: Column, least: int = 3, seconds: int = 3600) -> DataFrame:
    """Failures with which a host's circuit opens: so many different addresses of it failed within the time that ends with them."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    recent = Window.partitionBy(host).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    failed = events.where(bad).withColumn("_at", at)
    return failed.withColumn("failing", F.size(F.collect_set(url).over(recent))).where(F.col("failing") >= least).drop("_at")
