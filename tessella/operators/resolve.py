"""Events with what they refer to, as one row each; a reference to nothing stops the job, or is null where that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(found: Column, wanted: Column, event: Column, what: str, strict: bool) -> Column:
    """found, or an error that names the event and what it refers to."""
    if not strict:
        return found
    said = F.concat(F.lit("event "), event.cast("string"), F.lit(f" refers to a {what} that isn't there: "), wanted.cast("string"))
    return F.when(wanted.isNotNull() & found.isNull(), F.raise_error(said)).otherwise(found)


def one(events: DataFrame, event: str, key: str, dimension: DataFrame, dimension_key: str, name: str, strict: bool = True) -> DataFrame:
    """events with the struct ``name``: the row of the dimension that ``key`` leads to; a null key gives null, one that leads nowhere an error."""
    rows = dimension.select(F.col(dimension_key).alias("_key"), F.struct(*dimension.columns).alias("_row"))
    joined = events.join(rows, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(name, _checked(F.col("_row"), F.col(key), F.col(event), name, strict)).drop("_key", "_row")


def many(events: DataFrame, event: str, keys: str, dimension: DataFrame, dimension_key: str, name: str, strict: bool = True) -> DataFrame:
    """events with the array ``name``: the dimension's rows for the array ``keys``, in its order, repeats kept. Each reference is a row of the join, so
    a dimension row that most events share is no task of its own once it is broadcast or split."""
    each = events.select(F.col(event).alias("_event"), F.posexplode(keys).alias("_at", "_wanted"))
    rows = dimension.select(F.col(dimension_key).alias("_key"), F.struct(*dimension.columns).alias("_row"))
    met = each.join(rows, F.col("_wanted") == F.col("_key"), "left").select("_event", "_at", _checked(F.col("_row"), F.col("_wanted"), F.col("_event"), name, strict).alias("_row"))
    lists = met.groupBy("_event").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"]).alias(name))
    out = events.join(lists, F.col(event) == F.col("_event"), "left").drop("_event")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def citations(cited: DataFrame, event: str, source: str, events: DataFrame, primary: str, sources: DataFrame, source_key: str, strict: bool = True) -> DataFrame:
    """cited rows with the struct ``source_row`` and ``is_primary``: whether it is the source that the event names as its first."""
    own = cited.join(events.select(event, primary), event)
    return one(own, event, source, sources, source_key, "source_row", strict).withColumn("is_primary", F.coalesce(F.col(source) == F.col(primary), F.lit(False))).drop(primary)
