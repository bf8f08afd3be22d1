"""Readers of listings and detail pages: a registry of parsers from bodies to raw events, all DataFrame work.

A parser takes (url, body) rows and gives RAW rows; a body that is not what it should be gives none. Paged feeds say how many items
there are, and ``coverage`` tells whether all were seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import html
from tessella.functions.text import collapse

RAW = ("url", "external_id", "title", "start", "venue", "status", "detail_url")
Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {}


def parser(name: str) -> Callable[[Parser], Parser]:
    """Registers a parser under a source's kind."""

    def add(f: Parser) -> Parser:
        if name in PARSERS:
            raise ValueError(f"two parsers are named {name}")
        PARSERS[name] = f
        return f

    return add


def listing(pages: DataFrame, kind: str) -> DataFrame:
    """The raw events of pages of one kind, with why one can't be used (``discard``)."""
    found = PARSERS[kind](pages.select("url", "body"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(blank("title"), "missing-title").when(blank("start"), "missing-date").when(blank("detail_url"), "missing-url")
    return found.select(*RAW).withColumn("discard", reason)


def _raw(df: DataFrame, **columns: Column) -> DataFrame:
    given = {"url": F.col("url")} | columns
    return df.select(*((given[c] if c in given else F.lit(None)).cast("string").alias(c) for c in RAW))


@parser("json-feed")
def json_feed(pages: DataFrame) -> DataFrame:
    """{"total": n, "items": [{"id", "title", "start", "venue", "status", "url"}]}"""
    schema = "total bigint, items array<struct<id:string,title:string,start:string,venue:string,status:string,url:string>>"
    rows = pages.select("url", F.explode(F.from_json("body", schema)["items"]).alias("i"))
    return _raw(rows, external_id=F.col("i.id"), title=F.col("i.title"), start=F.col("i.start"), venue=F.col("i.venue"), status=F.col("i.status"), detail_url=F.col("i.url"))


@parser("wp-rest")
def wp_rest(pages: DataFrame) -> DataFrame:
    """Posts of a WordPress site: [{"id", "link", "date", "title": {"rendered"}}]"""
    rows = pages.select("url", F.explode(F.from_json("body", "array<struct<id:string,link:string,date:string,title:struct<rendered:string>>>")).alias("i"))
    return _raw(rows, external_id=F.col("i.id"), title=html.strip_tags(F.col("i.title.rendered")), start=F.col("i.date"), detail_url=F.col("i.link"))


@parser("tribe")
def tribe(pages: DataFrame) -> DataFrame:
    """The Events Calendar: {"total": n, "events": [{"id", "url", "title", "start_date", "status", "venue": {"venue"}}]}"""
    schema = "total bigint, events array<struct<id:string,url:string,title:string,start_date:string,status:string,venue:struct<venue:string>>>"
    rows = pages.select("url", F.explode(F.from_json("body", schema)["events"]).alias("i"))
    return _raw(rows, external_id=F.col("i.id"), title=html.strip_tags(F.col("i.title")), start=F.col("i.start_date"), venue=F.col("i.venue.venue"), status=F.col("i.status"), detail_url=F.col("i.url"))


@parser("json-ld")
def json_ld(pages: DataFrame) -> DataFrame:
    """Events in a page's ld+json scripts, alone, in a list or in @graph."""
    item = "struct<`@type`:string,name:string,startDate:string,eventStatus:string,url:string,location:struct<name:string>>"
    scripts = pages.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)).alias("s"))
    many, graph, one = F.from_json("s", f"array<{item}>"), F.from_json("s", f"struct<`@graph`:array<{item}>>")["@graph"], F.array(F.from_json("s", item))
    given = F.when(F.ltrim("s").startswith("["), many).when(F.size(graph) > 0, graph).otherwise(one)
    rows = scripts.select("url", F.explode(given).alias("i")).where(F.col("i.@type").endswith("Event"))
    status = F.lower(F.regexp_extract("i.eventStatus", r"Event(Cancelled|Postponed|Scheduled|Rescheduled)$", 1))
    return _raw(rows, external_id=F.col("i.url"), title=collapse(F.col("i.name")), start=F.col("i.startDate"), venue=F.col("i.location.name"), status=F.nullif(status, F.lit("")), detail_url=F.coalesce("i.url", "url"))


@parser("sitemap")
def sitemap(pages: DataFrame) -> DataFrame:
    """The addresses of a sitemap; what they are about is for the detail page to say."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<url>(.*?)</url>"), 1)).alias("i"))
    loc = html.decode_entities(F.trim(F.regexp_extract("i", r"(?is)<loc>(.*?)</loc>", 1)))
    return _raw(rows, external_id=loc, start=F.nullif(F.trim(F.regexp_extract("i", r"(?is)<lastmod>(.*?)</lastmod>", 1)), F.lit("")), detail_url=loc)


@parser("cards")
def cards(pages: DataFrame) -> DataFrame:
    """Links of a listing page with the text that they enclose, each address once a page."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("body", F.lit(r'(?is)(<a\b[^>]*?\bhref="[^"]*"[^>]*>.*?</a>)'), 1)).alias("i"))
    href, date = F.regexp_extract("i", r'(?is)^<a\b[^>]*?\bhref="([^"]*)"', 1), F.regexp_extract("i", r'(?is)<time[^>]*\bdatetime="([^"]*)"', 1)
    made = rows.select("url", html.decode_entities(href).alias("href"), html.strip_tags(F.col("i")).alias("title"), F.nullif(date, F.lit("")).alias("start"))
    each = made.groupBy("url", "href").agg(F.max("title").alias("title"), F.max("start").alias("start"))
    return _raw(each, external_id=F.col("href"), title=F.col("title"), start=F.col("start"), detail_url=F.col("href"))


def coverage(pages: DataFrame, total: str = "$.total", items: str = "$.items") -> DataFrame:
    """(told, seen, complete): how many items a paged feed says it has, and how many its pages hold."""
    seen = F.coalesce(F.json_array_length(F.get_json_object("body", items)), F.lit(0))
    out = pages.select(F.get_json_object("body", total).cast("long").alias("told"), seen.alias("seen")).agg(F.max("told").alias("told"), F.sum("seen").alias("seen"))
    return out.withColumn("complete", F.coalesce(F.col("seen") >= F.col("told"), F.lit(False)))


def selected(sources: DataFrame, wanted: list[str] | None = None, id_col: str = "id", enabled: str = "enabled") -> DataFrame:
    """The sources to run: those named, else all that are enabled; a name that is none raises."""
    if wanted is None:
        return sources.where(enabled)
    known = {r[0] for r in sources.where(F.col(id_col).isin(*wanted)).select(id_col).collect()}
    if set(wanted) - known:
        raise ValueError(f"no such sources: {sorted(set(wanted) - known)}")
    return sources.where(F.col(id_col).isin(*wanted))
