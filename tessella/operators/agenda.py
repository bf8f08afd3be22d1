"""Agenda queries: what is on, in order, by day, by venue.

Nothing sorts all rows in one place: cuts and breaks work on counts by day, of which there are few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text

from .places import numbered


def matches(filters: Mapping[str, str], columns: Mapping[str, Column]) -> Column:
    """The conjunction of an agenda's filters; empty and unknown ones hold for all.

    ``from`` and ``to`` bound ``date``; ``area``, ``access``, ``kind`` are equal; ``format``, ``era``, ``venue`` are in
    an array; ``municipality``, ``composer``, ``q`` are folded substrings (of an array: of one of its values).
    """
    out = F.lit(True)
    for key, value in filters.items():
        column = columns.get("date" if key in ("from", "to") else key)
        if not value.strip() or column is None:
            continue
        if key in ("from", "to"):
            bound = F.try_to_date(F.lit(value), "yyyy-MM-dd")
            test = F.coalesce(column >= bound if key == "from" else column <= bound, bound.isNull())
        elif key in ("area", "access", "kind"):
            test = column == value
        elif key in ("format", "era", "venue"):
            test = F.array_contains(column, value)
        elif key == "composer":
            test = F.exists(column, lambda x, value=value: text.contains(x, value))
        else:
            test = text.contains(column, value)
        out = out & test
    return out


def day_counts(rows: DataFrame, date: str) -> DataFrame:
    return rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"))


def first_page(rows: DataFrame, date: str, limit: int = 150) -> DataFrame:
    """The first ``limit`` rows by date, with all of the last day's."""
    so_far = F.sum("n").over(Window.orderBy(date)) - F.col("n")  # over days, not rows
    days = day_counts(rows, date).withColumn("before", so_far).where(F.col("before") < limit)
    return rows.join(days.select(date), date, "left_semi")


def with_today(days: DataFrame, date: str, today: str) -> DataFrame:
    """Days with their counts, and today with none if nothing is on."""
    none = days.sparkSession.range(1).select(F.lit(today).cast("date").alias(date), F.lit(0).cast("long").alias("n"))
    return days.unionByName(none).groupBy(date).agg(F.sum("n").alias("n"))


def inline_break(days: DataFrame, date: str, least: int = 8, most: int = 12, target: int = 10) -> DataFrame:
    """(date, total) after which a note goes: the day's end with a total in range that is nearest the target,
    else the nearest of those that reached ``least``; the earlier of two, never the last day. At most one row."""
    window = Window.orderBy(date)
    totals = days.withColumn("total", F.sum("n").over(window)).withColumn("last", F.lead(date).over(window).isNull())
    rank = F.struct((F.col("total") > most).alias("out"), F.abs(F.col("total") - target).alias("off"), F.col(date).alias("day"))
    best = totals.where(~F.col("last") & (F.col("total") >= least)).agg(F.min_by(F.struct(date, "total"), rank).alias("best"))
    return best.where("best is not null").select("best.*")


def next_occurrence(rows: DataFrame, key: str, date: str, wanted: Column, tie: str) -> DataFrame:
    """(key, date, tie) of the first wanted row of each key."""
    return rows.where(wanted).groupBy(key).agg(F.min(F.struct(date, tie)).alias("best")).select(key, "best.*")


def relevant_occurrence(rows: DataFrame, key: str, date: str, scheduled: Column, upcoming: Column, tie: str) -> DataFrame:
    """The next scheduled upcoming row of each key, else its last scheduled one, else its last."""
    row = F.struct(date, tie)
    best = F.coalesce(F.min(F.when(scheduled & upcoming, row)), F.max(F.when(scheduled, row)), F.max(row))
    return rows.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def rollup(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("next_date"))


def latest(rows: DataFrame, key: str, order: list[Column], most: int = 20) -> DataFrame:
    """The first ``most`` rows of each key. ``row_number() <= most`` is cut in each task before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def distinct_titles(items: DataFrame, title: str, facts: list[str]) -> DataFrame:
    """``title`` with as many facts as tell equal titles apart: each stage adds its fact to the titles that are
    still shared, if the sharers differ in it (the first stage always)."""
    for stage, fact in enumerate(facts):
        same = Window.partitionBy(title)
        shared = F.count(F.lit(1)).over(same) > 1
        value = F.coalesce(F.col(fact).cast("string"), F.lit("\0"))
        differ = F.lit(True) if stage == 0 else F.min(value).over(same) != F.max(value).over(same)
        longer = F.concat_ws(" · ", F.col(title), F.nullif(F.col(fact).cast("string"), F.lit("")))
        items = items.withColumn("_longer", F.when(shared & differ, longer).otherwise(F.col(title))).withColumn(title, F.col("_longer")).drop("_longer")
    return items


def related(items: DataFrame, id_col: str, shared: str, tag: str, kind: str, most: int = 3) -> DataFrame:
    """(id, other, score, place): 3 for the same ``shared``, 2 for the same ``tag``, 1 more for the same ``kind``; the best few.

    Whoever is among the best of an item is among the ``most + 1`` smallest ids of some class of items that are equal in what they
    share with it, so each item meets the few of its classes and no pairs of a class are formed.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(shared).alias("s"), F.col(tag).alias("t"), F.col(kind).alias("k"))
    found = None
    for keys in (["s", "t", "k"], ["s", "t"], ["s", "k"], ["s"], ["t", "k"], ["t"]):
        few = _first_of_class(rows, keys, most + 1)
        hit = rows.join(few, keys).select("id", "s", "t", "k", "o")
        found = hit if found is None else found.unionByName(hit)
    score = lambda c, n: F.when(F.col(c) == F.col(f"o.{c}"), n).otherwise(0)
    pairs = found.where(F.col("id") != F.col("o.id")).select("id", F.col("o.id").alias("other"), (score("s", 3) + score("t", 2) + score("k", 1)).alias("score")).distinct()
    return latest(pairs, "id", [F.desc("score"), F.asc("other")], most)


def _first_of_class(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows with the smallest ids of each class, in the struct ``o``; each task keeps only so many of a class before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("o", F.struct("id", "s", "t", "k")).withColumn("_place", place).where(F.col("_place") <= most).select(*keys, "o")


def placed(rows: DataFrame, date: str, order: list[str]) -> DataFrame:
    """Rows with their ``place`` by date, then ``order``: the rows of earlier days, counted by day, and the place within the day."""
    before = F.sum("n").over(Window.orderBy(date)) - F.col("n")  # over days, not rows
    days = day_counts(rows, date).withColumn("before", before).drop("n")
    within = F.row_number().over(Window.partitionBy(date).orderBy(*order))
    return rows.withColumn("within", within).join(days, date).withColumn("place", (F.col("before") + F.col("within")).cast("long")).drop("before", "within")


def slugs(rows: DataFrame, id_col: str, slug: str, aliases: str) -> DataFrame:
    """(id, slug, redirect): every slug that leads to a row; former ones redirect, unless some row has them now."""
    own = rows.select(id_col, F.col(slug).alias("slug"), F.lit(False).alias("redirect"))
    former = rows.select(id_col, F.explode(aliases).alias("slug")).join(own.select("slug"), "slug", "left_anti")
    return own.unionByName(former.select(id_col, "slug", F.lit(True).alias("redirect")))


def labelled(column: Column, labels: Mapping[str, str], other: str | None = None) -> Column:
    """The label of a value; a value without one is itself, or ``other``."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(names, column), column if other is None else F.lit(other))


def place_key(root: Column, venue: Column) -> Column:
    """One key for a place and its rooms: the root's slug, with the room's behind it if it is another."""
    return F.concat_ws("/", text.slug(root), F.when(text.fold(root) != text.fold(venue), text.slug(venue)))


def in_scope(date: Column, area: Column, today: str, last: str, areas: Sequence[str]) -> Column:
    """Whether a session is to be harvested: inside the window and in one of the areas, if that is known."""
    return date.between(F.lit(today).cast("date"), F.lit(last).cast("date")) & F.coalesce(area.isin(*areas), F.lit(True))


def event_page(events: DataFrame, sessions: DataFrame, key: str, date: str, today: str) -> DataFrame:
    """Events with their sessions' first and last day, how many are past and to come, and whether the whole event is past."""
    day = F.lit(today).cast("date")
    told = sessions.groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_if(F.col(date) < day).alias("past"), F.count_if(F.col(date) >= day).alias("to_come"), F.min(F.when(F.col(date) >= day, F.col(date))).alias("next"))
    zero = {"past": 0, "to_come": 0}
    return events.join(told, key, "left").fillna(zero).withColumn("is_past", (F.col("past") > 0) & (F.col("to_come") == 0))


def index_order(places: DataFrame, name: str, next_date: str, locale: str = "es") -> DataFrame:
    """Places with something on by their next date, then those without; each by name in the locale's order. ``place`` counts them all."""
    return numbered(places, [], [F.col(next_date).asc_nulls_last(), text.collated(F.col(name), locale).asc(), F.col(name).asc()])


def in_order(rows: DataFrame, date: str, time: str, title: str, ident: str, locale: str = "es") -> DataFrame:
    """Sessions with their ``place``: by date, time (unknown ones last), title in the locale's order, ident."""
    return numbered(rows, [], [F.col(date).asc(), F.col(time).asc_nulls_last(), text.collated(F.col(title), locale).asc(), F.col(ident).asc()])


def appearance(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value, place): the distinct values of each key in the order in which they first appear."""
    first = rows.groupBy(key, value).agg(F.min(at).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at", value)).cast("long")).drop("_at")


def only_future(published: DataFrame, incoming: DataFrame, key: str, date: str, values: Sequence[str], today: str) -> DataFrame:
    """Published rows with what incoming ones say of the same key and day, for days to come only: what is past stays as it was told."""
    new = incoming.select(key, date, F.struct(*values).alias("_n"))
    joined = published.join(new, [key, date], "left")
    change = (F.col(date) >= F.lit(today).cast("date")) & F.col("_n").isNotNull()
    return joined.withColumns({c: F.when(change, F.col(f"_n.{c}")).otherwise(F.col(c)) for c in values}).drop("_n")


def featured(rows: DataFrame, key: str, order: Column, ident: str) -> DataFrame:
    """rows with ``featured``: whether a row is the first of its key by ``order``. One minimum a key, so a common key is summed in every task first."""
    first = rows.groupBy(key).agg(F.min_by(ident, order).alias("_first"))
    return rows.join(first, key).withColumn("featured", F.col(ident) == F.col("_first")).drop("_first")
