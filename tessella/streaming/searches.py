"""Product events over streams: settled searches, claims, rates, upserts of a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def settled_searches(stream: DataFrame, key: str, ts: str, value: str, quiet: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last value of every burst of a key's events (a session that ends with ``quiet``), if it isn't empty."""
    last = F.max_by(value, F.struct(ts, value))
    bursts = stream.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("burst"), key).agg(last.alias(value), F.count(F.lit(1)).alias("events"))
    return bursts.where(F.col(value).isNotNull() & (F.col(value) != "")).select(key, F.col("burst.start").alias("began"), value, "events")


def claimed_once(stream: DataFrame, keys: list[str], ts: str, within: str = "1 day") -> DataFrame:
    """The first event of each key to arrive within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, key: str, ts: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events of a key in each sliding window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("began"), "n")


def start_upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``apply`` once, with its number, so that a repeated batch can be told."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
