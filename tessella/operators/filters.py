"""An agenda's filters as rows: parsed and checked, told in order, compared, named."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold

from .classify import ERAS, FORMATS

#: The keys in the order in which an address has them, and the values that a key may have (none given: any).
KEYS = ("q", "from", "to", "area", "municipality", "access", "format", "era", "kind", "venue", "composer")
VALUES: Mapping[str, tuple[str, ...]] = {"area": ("madrid", "nearby"), "access": ("free", "paid", "unknown"), "format": FORMATS, "era": ERAS, "kind": ("established", "alternative")}
#: Keys of free text, which is trimmed.
FREE = ("q", "municipality", "venue", "composer")


def _stated(query: Column) -> Column:
    """map of the known keys in a query string and the first value that each has there, decoded; those without a value are empty."""
    pairs = F.filter(F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.coalesce(F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")), F.lit("")).alias("v"))
    each = F.filter(F.transform(pairs, entry), lambda x: x["k"].isin(*KEYS))
    first = lambda k: F.try_element_at(F.filter(each, lambda x: x["k"] == k), F.lit(1))
    return F.map_from_entries(F.array_compact(F.transform(F.array(*map(F.lit, KEYS)), first)))


def present(query: Column) -> Column:
    """Whether an address has a filter's key at all, valid or not."""
    return F.size(_stated(query)) > 0


def parsed(query: Column) -> Column:
    """map of the filters in a query string: of each known key the first value, if that is a real date or among those allowed; free text is trimmed."""

    def right(k: Column, v: Column) -> Column:
        ok = (v != "") & (~k.isin("from", "to") | (v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(v, "yyyy-MM-dd").isNotNull()))
        for key, allowed in VALUES.items():
            ok = ok & ((k != key) | v.isin(*allowed))
        return ok

    return F.map_filter(F.transform_values(_stated(query), lambda k, v: F.when(k.isin(*FREE), F.trim(v)).otherwise(v)), right)


def told(filters: Column) -> Column:
    """The query string of filters, keys in their order; empty if there are none."""
    each = F.transform(F.array(*map(F.lit, KEYS)), lambda k: F.concat(k, F.lit("="), F.url_encode(F.element_at(filters, k))))
    return F.array_join(F.array_compact(each), "&")


def canonical_venue(rows: DataFrame, value: str, places: DataFrame) -> DataFrame:
    """rows with a venue filter's ``value`` mapped to the slug of the place it belongs to, whether it is that place's slug or id or one of a room's;
    an unknown value stays, and so does null. ``places``: (slug, id, root_slug), rooms and the places themselves."""
    keys = places.select(F.explode(F.array("slug", "id")).alias("_key"), "root_slug").where("_key is not null")
    keys = keys.groupBy("_key").agg(F.min("root_slug").alias("_root"))
    return rows.join(keys, F.col(value) == F.col("_key"), "left").withColumn(value, F.coalesce("_root", value)).drop("_key", "_root")


def slim(occurrences: DataFrame) -> DataFrame:
    """What filters ask of a session, and nothing else: a composer list from composers and works, and one text for searches.

    Takes the resolved columns (occurrence, date, time, access, formats, eras, kind, area, municipality, venue_slug, venue_keys, title, root_name, space_name, venue_name,
    series_name, organizer_names, performer_names, composer_names, work_titles, work_composers).
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    composers = F.array_compact(F.concat(some("composer_names"), some("work_composers")))
    said = F.array_join(F.array_compact(F.concat(F.array("title", "root_name", "space_name", "venue_name", "municipality", "series_name"), some("organizer_names"), some("performer_names"), composers, some("work_titles"))), " ")
    kept = ("occurrence", "date", "time", "access", "formats", "eras", "kind", "area", "municipality", "venue_slug", "venue_keys")
    return occurrences.select(*kept, composers.alias("composers"), fold(said).alias("search"))


def fits(filters: Column) -> Column:
    """Whether a slim row passes a map of filters; a key that isn't there passes."""
    want = lambda k: F.element_at(filters, F.lit(k))
    ok = lambda k, test: want(k).isNull() | F.coalesce(test(want(k)), F.lit(False))
    out = ok("from", lambda v: F.col("date") >= v.cast("date")) & ok("to", lambda v: F.col("date") <= v.cast("date"))
    for key in ("area", "municipality", "access", "kind"):
        out = out & ok(key, lambda v, key=key: F.col(key) == v)
    out = out & ok("format", lambda v: F.array_contains("formats", v)) & ok("era", lambda v: F.array_contains("eras", v))
    out = out & ok("venue", lambda v: (F.col("venue_slug") == v) | F.array_contains("venue_keys", v))
    out = out & ok("composer", lambda v: F.exists("composers", lambda c: F.contains(fold(c), fold(v))))
    return out & ok("q", lambda v: F.contains(F.col("search"), fold(v)))


def active(filters: Column, ignore: Sequence[str] = ()) -> Column:
    """How many filters there are."""
    return F.size(F.filter(F.map_keys(filters), lambda k: ~k.isin(*ignore) if ignore else F.lit(True)))


def changed(before: Column, after: Column) -> Column:
    """The keys that were set, cleared or given another value, in order, each with what happened to it."""
    def what(k: Column) -> Column:
        a, b = F.element_at(before, k), F.element_at(after, k)
        return F.when(a.isNull() & b.isNotNull(), F.concat(F.lit("set:"), k)).when(a.isNotNull() & b.isNull(), F.concat(F.lit("clear:"), k)).when(a != b, F.concat(F.lit("change:"), k))

    return F.array_compact(F.transform(F.array(*map(F.lit, KEYS)), what))


def chips(filters: Column, labels: Mapping[str, str]) -> Column:
    """A label for each filter, in order: the value's own label if it has one, else the value."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.array_compact(F.transform(F.array(*map(F.lit, KEYS)), lambda k: F.coalesce(F.element_at(names, F.concat(k, F.lit("="), F.element_at(filters, k))), F.element_at(filters, k))))


def toggled(filters: Column, key: str, value: str) -> Column:
    """Filters with a shortcut's value set, or without it if they had it."""
    has = F.coalesce(F.element_at(filters, F.lit(key)) == value, F.lit(False))
    rest = F.map_filter(filters, lambda k, _: k != key)
    return F.when(has, rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), F.lit(value))))


def usage(rows: DataFrame, filters: str) -> DataFrame:
    """(key, n): how often each filter is used."""
    return rows.select(F.explode(F.map_keys(filters)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
