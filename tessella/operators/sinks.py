"""Whole files for those outside: a calendar for each session, structured data for search engines, site maps in parts, sheets of rows.

Texts are made as Columns and written by Spark, a folder a file, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import civil

from .export import folded, ics_escape, xml_escape
from .places import numbered

CRLF = "\r\n"
ROLES: Mapping[str, str] = {"orchestra": "MusicGroup", "choir": "MusicGroup", "ensemble": "MusicGroup"}


def calendar(uid: Column, date: Column, time: Column, title: Column, place: Column, description: Column, url: Column, verified: Column, status: Column, product: str = "-//tessella//agenda//ES", zone: str = civil.ZONE) -> Column:
    """A whole iCalendar document of one session: an instant in UTC where the time is known, else a day; without an end, as none is known; the stamp is the day of verification."""
    start = civil.to_utc(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time), zone)
    begins = F.when(time.isNotNull(), F.concat(F.lit("DTSTART:"), F.date_format(start, "yyyyMMdd'T'HHmmss'Z'"))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(date, "yyyyMMdd")))
    text = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", folded(F.concat(F.lit(f"{name}:"), ics_escape(value))))
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("CALSCALE:GREGORIAN"), F.lit("BEGIN:VEVENT"), folded(F.concat(F.lit("UID:"), uid)), F.concat(F.lit("DTSTAMP:"), F.date_format(verified, "yyyyMMdd"), F.lit("T000000Z")), begins,
        text("SUMMARY", title), text("LOCATION", place), text("DESCRIPTION", description), folded(F.concat(F.lit("URL:"), url)), F.when(status == "cancelled", "STATUS:CANCELLED"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF))


def structured(name: Column, start: Column, status: Column, place: Column, url: Column, ident: Column, access: Column, performers: Column, organizers: Column, series: Column) -> Column:
    """A session as JSON-LD: performers (array of struct(name, role)) as groups or persons, organisers, whether it is free if that is known, and the series it belongs to. What isn't known isn't there."""
    told = F.concat(F.lit("https://schema.org/"), F.when(status == "cancelled", "EventCancelled").when(status == "postponed", "EventPostponed").otherwise("EventScheduled"))
    kind = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    person = lambda p: F.struct(F.coalesce(F.try_element_at(kind, p["role"]), F.lit("Person")).alias("@type"), p["name"].alias("name"))
    some = lambda c, value: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, value)
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("MusicEvent").alias("@type"), F.concat(url, F.lit("#"), ident).alias("@id"), name.alias("name"), start.alias("startDate"), told.alias("eventStatus"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"), F.struct(F.lit("Place").alias("@type"), place.alias("name")).alias("location"), url.alias("url"), F.when(access == "free", True).when(access == "paid", False).alias("isAccessibleForFree"),
        some(organizers, F.transform(organizers, lambda o: F.struct(F.lit("Organization").alias("@type"), o.alias("name")))).alias("organizer"), some(performers, F.transform(performers, person)).alias("performer"),
        F.when(F.coalesce(series, F.lit("")) != "", F.struct(F.lit("EventSeries").alias("@type"), series.alias("name"))).alias("superEvent"),
    ))


def site_maps(pages: DataFrame, base: str, path: str, changed: str | None = None, most: int = 50_000) -> DataFrame:
    """(file, place, line) of site maps with up to ``most`` pages each, in order of their paths: every file has its head and foot, places order its lines."""
    placed = numbered(pages, [], [F.col(path).asc()], "_place").withColumn("file", F.floor((F.col("_place") - 1) / most))
    entries = placed.select("file", F.col("_place").alias("place"), sitemap_entry(base, path, changed).alias("line"))
    ends = placed.groupBy("file").agg(F.max("_place").alias("last"), F.min("_place").alias("first"))
    head = ends.select("file", (F.col("first") - 1).alias("place"), F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">').alias("line"))
    foot = ends.select("file", (F.col("last") + 1).alias("place"), F.lit("</urlset>").alias("line"))
    return entries.unionByName(head).unionByName(foot)


def sitemap_entry(base: str, path: str, changed: str | None = None) -> Column:
    last = F.lit("") if changed is None else F.coalesce(F.concat(F.lit("<lastmod>"), F.col(changed).cast("string"), F.lit("</lastmod>")), F.lit(""))
    return F.concat(F.lit(f"<url><loc>{base}"), xml_escape(F.col(path)), F.lit("</loc>"), last, F.lit("</url>"))


def write_lines(lines: DataFrame, target: str, file: str = "file", place: str = "place", line: str = "line") -> None:
    """Writes lines in order, a folder a file; one file's lines are in one task."""
    ordered = lines.repartition(F.col(file)).sortWithinPartitions(file, place)
    ordered.select(F.col(file), F.col(line)).write.partitionBy(file).mode("errorifexists").text(target)


def write_documents(documents: DataFrame, target: str, name: str, text: str) -> None:
    """Writes one document a row, each in a folder of its name, as it is."""
    documents.select(F.col(name), F.col(text)).write.partitionBy(name).mode("errorifexists").option("lineSep", "\n").text(target)


def sheets(rows: Mapping[str, DataFrame], target: str) -> None:
    """A folder of CSV files for each named sheet, with a header."""
    for name, df in rows.items():
        flat = [F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
        df.select(*flat).write.mode("errorifexists").option("header", True).csv(f"{target.rstrip('/')}/{name}")
