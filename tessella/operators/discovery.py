"""Observations that people or programs bring from outside: checked, given a source, and held against the sources that are read anyway.

An observation is a row (id, url, title, source_name, occurrences as array of struct(date, time), venue, description, programme, external), as ``sources.journal.observations`` reads them from batches. A batch
loses nothing by a bad row: each has its own list of problems.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import urls
from tessella.functions.idents import tail
from tessella.functions.text import fold

#: Fields that make an observation rich.
RICH = ("description", "programme", "venue", "external")


def _some(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def problems(title: Column, url: Column, occurrences: Column) -> Column:
    """array of "path: problem" of one observation; empty if it can be used."""
    real = lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull() & d.rlike(r"^\d{4}-\d{2}-\d{2}$")
    clock = lambda t: t.isNull() | t.rlike(r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]$")
    each = F.transform(
        F.coalesce(occurrences, F.array().cast("array<struct<date:string,time:string>>")),
        lambda o, i: F.when(~F.coalesce(real(o["date"]), F.lit(False)), F.concat(F.lit("event.occurrences."), i.cast("string"), F.lit(".date: no day of the calendar"))).when(~clock(o["time"]), F.concat(F.lit("event.occurrences."), i.cast("string"), F.lit(".time: no time of day"))),
    )
    own = F.array(
        F.when(~_some(title), "event.title: missing"), F.when(~_some(url), "source.url: missing").when(~url.rlike(r"(?i)^https?://[^/?#\s]+\.[^/?#\s]+"), "source.url: no web address"), F.when(F.coalesce(F.size(occurrences), F.lit(0)) <= 0, "event.occurrences: missing"),
    )
    return F.array_compact(F.concat(own, each))


def site(url: Column) -> Column:
    """The host without www., by which sources are told apart."""
    return F.regexp_replace(F.lower(urls.host(F.trim(url))), r"^www\.", "")


def sourced(rows: DataFrame, url: str, sources: DataFrame, source: str, home: str) -> DataFrame:
    """rows with ``source`` and ``known``: the source whose home has the observation's site, the smallest where several have it, else a new one named after the site."""
    homes = sources.select(site(F.col(home)).alias("_site"), F.col(source).alias("_source")).where("_site != ''").groupBy("_site").agg(F.min("_source").alias("_source"))
    joined = rows.withColumn("_site", site(F.col(url))).join(homes, "_site", "left")
    made = F.when(F.col("_site") != "", F.concat(F.lit("src_"), tail(F.col("_site"), 116)))
    return joined.withColumns({"source": F.coalesce("_source", made), "known": F.col("_source").isNotNull()}).drop("_site", "_source")


def adapter_gaps(rows: DataFrame, registered: DataFrame, source: str, url: str, title: str) -> DataFrame:
    """(source, n, first, last): sources that an adapter reads and of which something was brought from outside all the same: what the adapter misses. The first and last address stand for the list."""
    met = rows.join(registered.select(source).distinct(), source, "left_semi")
    address = F.struct(url, title)
    return met.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(address)[url].alias("first"), F.max(address)[url].alias("last"))


def evidence(rows: DataFrame, url: str, rich: Sequence[str] = RICH) -> DataFrame:
    """rows with ``url_kind`` (listing or event-detail) and ``richness``: sparse with fewer than two of the fields that tell more than a title, complete with all, else partial."""
    there = sum((F.when(_some(F.col(c)), 1).otherwise(0) for c in rich), F.lit(0))
    return rows.withColumns({"url_kind": urls.kind(F.col(url)), "richness": F.when(there < 2, "sparse").when(there == len(rich), "complete").otherwise("partial")})


def yields(rows: DataFrame, found_via: str) -> DataFrame:
    """(found_via, n, usable, listings, sparse): what each way of searching brought."""
    return rows.groupBy(found_via).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("problems") == 0).alias("usable"), F.count_if(F.col("url_kind") == "listing").alias("listings"), F.count_if((F.col("url_kind") == "event-detail") & (F.col("richness") == "sparse")).alias("sparse"))


def repeated(rows: DataFrame, ident: str, url: str, title: str) -> DataFrame:
    """(id, first): observations whose normalised address and folded title an earlier one (by id) has."""
    keyed = rows.select(F.col(ident).alias("id"), F.xxhash64(urls.normalize(F.col(url)), fold(F.col(title))).alias("_key"), urls.normalize(F.col(url)).alias("_url"), fold(F.col(title)).alias("_title"))
    first = keyed.groupBy("_key", "_url", "_title").agg(F.min("id").alias("first"))
    return keyed.join(first, ["_key", "_url", "_title"]).where("id != first").select("id", "first")
