"""How much of its agenda a source has shown, and what follows from that for what it no longer shows.

A listing may be whole, stop early (its rows count, but nothing can be missing), or be whole for some days only. Coverage is kept as rows beside the listing's own, so an incomplete listing loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(pages: DataFrame, source: str, expected: str, ok: str, first: str, last: str) -> DataFrame:
    """(source, whole, first, last, reason) from a row a page of a listing: how many pages it says it has, whether the page was read, the days on it.

    A source is whole if all expected pages were read; the days for which it is sure are those of the pages read. A source with no page read has failed.
    """
    out = pages.groupBy(source).agg(F.max(expected).alias("_expected"), F.count_if(F.col(ok)).alias("_read"), F.min(F.when(F.col(ok), F.col(first))).alias("first"), F.max(F.when(F.col(ok), F.col(last))).alias("last"))
    whole = F.col("_read") >= F.coalesce("_expected", F.lit(1))
    reason = F.when(F.col("_read") == 0, "failed").when(~whole, "incomplete-listing")
    return out.select(source, whole.alias("whole"), "first", "last", reason.alias("reason"))


def unseen(published: DataFrame, seen: DataFrame, coverage: DataFrame, key: str, source: str, date: str, today: str) -> DataFrame:
    """(key, source, date, state): published rows to come that their source no longer shows.

    "possibly-missing" where the source is whole, or sure for that day; "withheld" where it isn't, or has failed, or wasn't asked. Past ones are no question.
    """
    gone = published.where(F.col(date) >= F.lit(today).cast("date")).join(seen.select(key, source).distinct(), [key, source], "left_anti")
    told = coverage.select(source, "whole", "first", "last", "reason")
    joined = gone.join(told, source, "left")
    sure = F.coalesce(F.col("whole"), F.lit(False)) & (F.col("reason").isNull())
    return joined.select(key, source, date, F.when(sure & F.coalesce(F.col(date).between(F.col("first"), F.col("last")), F.lit(False)), "possibly-missing").otherwise("withheld").alias("state"))


def kept(listings: DataFrame, coverage: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """A listing's rows, those of incomplete ones too, with ``partial`` where the source isn't whole."""
    return listings.select(source, *columns).join(coverage.select(source, "whole"), source, "left").withColumn("partial", ~F.coalesce("whole", F.lit(False))).drop("whole")
