"""Record linkage: candidates by method, collapse, slots, calendars, upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("external-id", "url", "alias", "strong", "slot")


def candidates(observed: DataFrame, known: DataFrame, methods: Mapping[str, Sequence[str]], id_col: str, known_id: str) -> DataFrame:
    """(id, method, n, first): how many known rows are equal to an observation in a method's columns, and the smallest.

    The known side is summed to one row a key before the join, so a common key makes no pairs.
    """
    found = None
    for name, on in methods.items():
        left = observed.select(id_col, *on).dropna(subset=list(on))
        right = known.dropna(subset=list(on)).groupBy(*on).agg(F.countDistinct(known_id).alias("n"), F.min(known_id).alias("first"))
        hit = left.join(right, list(on)).select(id_col, F.lit(name).alias("method"), "n", "first")
        found = hit if found is None else found.union(hit)
    return found


def collapse(found: DataFrame, id_col: str, sure: Sequence[str] = METHODS[:2]) -> DataFrame:
    """matched (all methods give one and the same), matched-many (several, all by sure methods) or ambiguous."""
    out = found.groupBy(id_col).agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("first").alias("last"), F.count_if(~F.col("method").isin(*sure)).alias("unsure"))
    verdict = F.when((F.col("n") == 1) & (F.col("first") == F.col("last")), "matched").when(F.col("unsure") == 0, "matched-many").otherwise("ambiguous")
    return out.select(id_col, "n", "first", verdict.alias("verdict"))


def venue_relation(a: Column, a_parent: Column, b: Column, b_parent: Column) -> Column:
    out = F.when(a.isNull() | b.isNull(), "absent").when(a == b, "same").when(a_parent == b, "refinement").when(b_parent == a, "coarser")
    return out.when(a_parent == b_parent, "sibling").otherwise("unrelated")


def precise(occurrences: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows without a time take the only time of their keys, and go where there are several; exact repeats go."""
    times = occurrences.groupBy(*keys).agg(F.countDistinct(time).alias("times"), F.min(time).alias("only"))
    joined = occurrences.select(*keys, time).distinct().join(times, list(keys))
    kept = joined.where(F.col(time).isNotNull() | (F.col("times") <= 1))
    return kept.select(*keys, F.coalesce(time, "only").alias(time)).distinct()


def scoped_union(first: DataFrame, second: DataFrame, key: str, date: str, scopes: DataFrame) -> DataFrame:
    """All of ``first``, and what ``second`` adds outside the intervals (key, from, to) that ``first`` vouches for."""
    inside = (F.col("o." + key) == F.col("s." + key)) & F.col("o." + date).between(F.col("s.from"), F.col("s.to"))
    outside = second.alias("o").join(scopes.alias("s"), inside, "left_anti")
    return first.unionByName(outside).distinct()


def upsert(published: DataFrame, incoming: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """Merges by key. A column's rule: "published" (kept if known), "incoming" (taken if stated), "fill" (as published,
    unless null or empty), "max". ``change`` says created, updated, unchanged or untouched."""
    p = published.select(F.col(key), F.struct(*rules).alias("p"))
    n = incoming.select(F.col(key), F.struct(*rules).alias("n"))
    both = p.join(n, key, "full_outer")

    def merged(c: str, rule: str) -> Column:
        old, new = F.col(f"p.{c}"), F.col(f"n.{c}")
        if rule == "max":
            return F.greatest(old, new)
        if rule == "fill":
            return F.coalesce(F.nullif(old, F.lit("")), new)
        return F.coalesce(old, new) if rule == "published" else F.coalesce(new, old)

    out = both.select(key, "p", "n", *(merged(c, r).alias(c) for c, r in rules.items()))
    material = [c for c, r in rules.items() if r != "max"]
    moved = F.lit(False)
    for c in material:
        moved = moved | ~F.col(f"p.{c}").eqNullSafe(F.col(c))
    change = F.when(F.col("p").isNull(), "created").when(F.col("n").isNull(), "untouched").when(moved, "updated").otherwise("unchanged")
    return out.select(key, *rules, change.alias("change"))


def monotone(published: Column, incoming: Column) -> Column:
    """The published list, with incoming values added if incoming has all that is published."""
    return F.when(F.size(F.array_except(published, incoming)) == 0, F.array_union(published, incoming)).otherwise(published)


def missing(published: DataFrame, key: str, source: str, healthy: DataFrame, seen: DataFrame) -> DataFrame:
    """Published rows of sources that ran well which those sources no longer show."""
    return published.join(healthy.select(source).distinct(), source, "left_semi").join(seen.select(key).distinct(), key, "left_anti")


def assigned(observed: DataFrame, owned: DataFrame, key: str, event: str, date: str) -> DataFrame:
    """Sessions of observations that belong to several events: each goes to the one event that has its date. ``owners`` says how many have it: with
    none, or with several (which is ambiguous), the event is null."""
    owners = owned.select(key, event, date).distinct().groupBy(key, date).agg(F.min(event).alias(event), F.count(F.lit(1)).alias("owners"))
    joined = observed.join(owners, [key, date], "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    return joined.withColumn(event, F.when(F.col("owners") == 1, F.col(event)))


def distinct_evidence(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, evidence): the distinct statements about a key, as JSON in order."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.to_json(F.struct(*columns)))).alias("evidence"))


def covers(intervals: DataFrame, key: str, first: str, last: str, wanted: DataFrame, date: str) -> DataFrame:
    """(key, date, covered): whether some interval of its key has a date."""
    return wanted.alias("w").join(intervals.select(F.col(key).alias("_k"), F.col(first).alias("_a"), F.col(last).alias("_b")), (F.col("_k") == F.col(key)) & F.col(date).between(F.col("_a"), F.col("_b")), "left").groupBy(key, date).agg(F.count("_k").alias("n")).select(
        key, date, (F.col("n") > 0).alias("covered")
    )
