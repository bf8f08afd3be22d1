"""What a source says of an event, cleaned and put together from listing and detail page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import collapse


def lines(text: Column) -> Column:
    """White space as one space within each line; lines stay, empty ones go."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), collapse), lambda x: x != ""), "\n")


def normalise(rows: DataFrame, title: str, sessions: str, texts: Sequence[str], programme: str | None = None, conflict: str | None = None) -> DataFrame:
    """Rows with clean texts and ``discard``: why a row can't be used (null: it can)."""
    clean = {c: F.nullif(collapse(F.col(c)), F.lit("")) for c in (title, *texts)}
    if programme:
        clean[programme] = F.nullif(lines(F.col(programme)), F.lit(""))
    out = rows.withColumns(clean)
    reason = F.when(F.col(title).isNull(), "missing-title").when(F.coalesce(F.size(sessions), F.lit(0)) <= 0, "missing-date")
    return out.withColumn("discard", reason.when(F.coalesce(F.col(conflict), F.lit(False)), "source-conflict") if conflict else reason)


def with_detail(listing: DataFrame, detail: DataFrame, key: str, texts: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """The listing's row with what its detail page tells better: texts that are not empty, lists that have something."""
    d = detail.select(key, F.struct(*texts, *lists).alias("d"))
    joined = listing.join(d, key, "left")
    put = {c: F.coalesce(F.nullif(F.trim(F.col(f"d.{c}")), F.lit("")), F.col(c)) for c in texts}
    put |= {c: F.when(F.size(f"d.{c}") > 0, F.col(f"d.{c}")).otherwise(F.col(c)) for c in lists}
    return joined.withColumns(put).drop("d")


def discrepancies(listing: DataFrame, detail: DataFrame, key: str, date: str, time: str) -> DataFrame:
    """(key, kind, date): dates that only one of the two gives, and dates for which they give different times."""
    each = [df.groupBy(key, date).agg(F.array_join(F.sort_array(F.collect_set(time)), " ").alias(c)) for df, c in ((listing, "listed"), (detail, "detailed"))]
    both = listing.select(key).distinct().join(detail.select(key).distinct(), key)  # keys that both have
    joined = each[0].join(each[1], [key, date], "full_outer").join(both, key, "left_semi")
    kind = F.when(F.col("listed").isNull() | F.col("detailed").isNull(), "dates").when((F.col("listed") != F.col("detailed")) & (F.col("listed") != "") & (F.col("detailed") != ""), "times")
    return joined.select(key, kind.alias("kind"), date).where("kind is not null")


def enriched(stated: Column, attributed: Column, from_title: Column, performers: Column) -> Column:
    """Composers as stated, else as the programme's text attributes them, else as the title has them; never one who performs."""
    some = lambda c: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(performers, F.array().cast("array<string>")))
    return F.when(F.size(some(stated)) > 0, some(stated)).when(F.size(some(attributed)) > 0, some(attributed)).otherwise(some(from_title))


def upsert_citations(published: DataFrame, incoming: DataFrame, key: str, source: str, url: str, checked: str) -> DataFrame:
    """Citations by (key, source, url), each with the last day it was checked."""
    return published.unionByName(incoming).groupBy(key, source, url).agg(F.max(checked).alias(checked))
