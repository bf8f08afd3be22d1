"""Rows for files: string lists, calendar entries, counts with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import civil


def joined(values: Column, separator: str = "; ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), separator)


def with_zeros(all_rows: DataFrame, key: str, counts: DataFrame, names: list[str]) -> DataFrame:
    out = all_rows.select(key).join(counts, key, "left")
    return out.select(key, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


def ics_escape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def ics(uid: Column, day: Column, title: Column, place: Column) -> Column:
    """One all-day calendar entry."""
    stamp = F.date_format(day, "yyyyMMdd")
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp), F.concat(F.lit("SUMMARY:"), ics_escape(title)), F.concat(F.lit("LOCATION:"), ics_escape(place)), F.lit("END:VEVENT"))


def json_ld(kind: str, **values: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("@type"), *(v.alias(k) for k, v in values.items())))


def timed_event(uid: Column, day: Column, time: Column, title: Column) -> Column:
    """One calendar entry at a civil time, as an instant."""
    start = civil.to_utc(F.concat_ws(" ", day.cast("string"), time))
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), F.date_format(start, "yyyyMMdd'T'HHmmss'Z'")), F.concat(F.lit("SUMMARY:"), ics_escape(title)), F.lit("END:VEVENT"))


def folded(line: Column, most: int = 75) -> Column:
    """A content line in pieces of ``most`` octets, between whole characters; each piece after the first begins with a space."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(acc: Column, c: Column) -> Column:
        size = F.octet_length(c)
        over = acc["n"] + size > most
        return F.struct(F.concat(acc["out"], F.when(over, "\r\n ").otherwise(""), c).alias("out"), F.when(over, size + 1).otherwise(acc["n"] + size).alias("n"))

    return F.aggregate(F.split(line, ""), start, put)["out"]


def event_json(name: Column, start: Column, status: Column, place: Column) -> Column:
    """An event for search engines."""
    told = F.concat(F.lit("https://schema.org/"), F.when(status == "cancelled", "EventCancelled").when(status == "postponed", "EventPostponed").otherwise("EventScheduled"))
    location = F.struct(F.lit("Place").alias("@type"), place.alias("name"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("MusicEvent").alias("@type"), name.alias("name"), start.alias("startDate"), told.alias("eventStatus"), location.alias("location")))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sitemap(pages: DataFrame, base: str, path: str, changed: str | None = None) -> DataFrame:
    """One ``entry`` a page, with the day it was last changed if that is known."""
    loc = F.concat(F.lit(f"<url><loc>{base}"), xml_escape(F.col(path)), F.lit("</loc>"))
    last = F.lit("") if changed is None else F.coalesce(F.concat(F.lit("<lastmod>"), F.col(changed).cast("string"), F.lit("</lastmod>")), F.lit(""))
    return pages.select(F.concat(loc, last, F.lit("</url>")).alias("entry"))


def lastmod(entries: DataFrame, feed: str, changed: str, today: str) -> DataFrame:
    """(feed, lastmod, n): the last day up to today on which one of a feed's entries changed, and how many there are; entries to come don't count."""
    return entries.where(F.col(changed) <= F.lit(today).cast("date")).groupBy(feed).agg(F.max(changed).alias("lastmod"), F.count(F.lit(1)).alias("n"))
