"""Validation checks. Each gives rows (code, severity, path, message); a report is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.storage import settled


def _issue(code: str, path: Column, message: Column, severity: str = "error") -> list[Column]:
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), message.cast("string").alias("message")]


def dangling(rows: DataFrame, id_col: str, key: str, dimension: DataFrame, dimension_key: str, code: str) -> DataFrame:
    """Rows whose key is set and not in the dimension."""
    known = dimension.select(F.col(dimension_key).alias(key))
    return rows.where(F.col(key).isNotNull()).join(known, key, "left_anti").select(*_issue(code, F.col(id_col), F.col(key)))


def duplicate_keys(rows: DataFrame, id_col: str, key: Column, code: str, severity: str = "error") -> DataFrame:
    """Keys that several ids have: how many have it, and the smallest and largest of those."""
    groups = rows.select(key.alias("key"), F.col(id_col).alias("id")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return groups.where("n > 1").select(*_issue(code, F.col("key"), F.concat_ws(" ", "n", "first", "last"), severity))


def later_duplicates(rows: DataFrame, id_col: str, key: Column, code: str, severity: str = "error") -> DataFrame:
    """Each row whose key an earlier row (by id) has, with that row's id. One grouped minimum joined back, so a key
    with many rows is summed in every task first."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key")).where("key is not null")
    first = keyed.groupBy("key").agg(F.min("id").alias("first"))
    return keyed.join(first, "key").where("id != first").select(*_issue(code, F.col("id"), F.col("first"), severity))


def repeated_in_array(rows: DataFrame, id_col: str, array: str, code: str, severity: str = "warning") -> DataFrame:
    return rows.where(F.size(F.array_distinct(array)) < F.size(array)).select(*_issue(code, F.col(id_col), F.col(array).cast("string"), severity))


def failing(rows: DataFrame, id_col: str, bad: Column, code: str, severity: str = "error") -> DataFrame:
    return rows.where(bad).select(*_issue(code, F.col(id_col), F.lit(code), severity))


def collisions(rows: DataFrame, id_col: str, slot: list[str], fact: str) -> DataFrame:
    """Slots that several rows hold: all facts equal is a duplicate, all known and different a conflict, else to review.

    Verdicts come from one aggregate a slot; pairs inside it are not formed.
    """
    groups = rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"), F.countDistinct(fact).alias("facts"), F.count(fact).alias("known"))
    verdict = F.when(F.col("known") < F.col("n"), "schedule-review").when(F.col("facts") == 1, "schedule-duplicate").otherwise("schedule-conflict")
    return groups.where("n > 1").withColumn("code", verdict)


def parent_cycles(rows: DataFrame, id_col: str, parent: str) -> DataFrame:
    """Self parents, missing parents and parents that have a parent (a hierarchy has one level)."""
    above = rows.select(F.col(id_col).alias(parent), F.col(parent).alias("grand"), F.lit(True).alias("found"))
    joined = rows.where(F.col(parent).isNotNull()).join(above, parent, "left")
    code = F.when(F.col(id_col) == F.col(parent), "self-parent-venue").when(F.col("found").isNull(), "missing-parent-venue").when(F.col("grand").isNotNull(), "nested-venue-parent")
    return joined.withColumn("code", code).where("code is not null").select("code", F.lit("error").alias("severity"), F.col(id_col).cast("string").alias("path"), F.col(parent).cast("string").alias("message"))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("place = 1").drop("place")


def bad_array_refs(rows: DataFrame, id_col: str, array: str, dimension: DataFrame, dimension_key: str, code: str) -> DataFrame:
    """Values of an array that are not in the dimension."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(array).alias("key"))
    return each.join(dimension.select(F.col(dimension_key).alias("key")), "key", "left_anti").select(*_issue(code, F.col("id"), F.col("key")))


def repeated(rows: DataFrame, keys: list[str], id_col: str, code: str, severity: str = "error") -> DataFrame:
    """Keys that occur more than once below one id."""
    groups = rows.groupBy(id_col, *keys).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    return groups.select(*_issue(code, F.col(id_col), F.concat_ws(" ", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)), severity))


def impossible_dates(rows: DataFrame, id_col: str, date: str) -> DataFrame:
    """Dates as text that are no day of the calendar."""
    real = F.when(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(date), "yyyy-MM-dd"))
    return failing(rows.where(F.col(date).isNotNull()), id_col, real.isNull(), "impossible-date")


def cancelled_but_active(events: DataFrame, occurrences: DataFrame, id_col: str, status: str, occurrence_status: str) -> DataFrame:
    active = occurrences.where(F.col(occurrence_status) != "cancelled").select(id_col).distinct()
    return events.where(F.col(status) == "cancelled").join(active, id_col, "left_semi").select(*_issue("cancelled-event-active-occurrence", F.col(id_col), F.col(status)))


def place_issues(venues: DataFrame, id_col: str, parent: str, space: str, address: str) -> DataFrame:
    """A parent without a space's name or the other way round, no address of its own or its parent's, and parents that come round."""
    xor = failing(venues, id_col, F.col(parent).isNull() != F.col(space).isNull(), "venue-space-mismatch")
    above = venues.select(F.col(id_col).alias(parent), F.col(address).alias("above_address"), F.col(parent).alias("grand"))
    joined = venues.join(above, parent, "left")
    bare = failing(joined, id_col, F.coalesce(F.nullif(F.col(address), F.lit("")), F.nullif(F.col("above_address"), F.lit(""))).isNull(), "missing-venue-address")
    return xor.union(bare).union(parent_loops(venues, id_col, parent))


def parent_loops(rows: DataFrame, id_col: str, parent: str) -> DataFrame:
    """Rows that are their own ancestor. Pointers double in reach each round, until no row that is left has an ancestor; rows on
    a way into a loop go with its members' rows, so what stays after as many rounds as double past all rows is in a loop or leads to one."""
    up = rows.where(F.col(parent).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent).alias("to"))
    far, left = settled(up)
    for _ in range(left.bit_length()):
        if not left:
            break
        far, left = settled(far.alias("a").join(far.alias("b"), F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to")))
    reached = far.select(F.col("to").alias("id")).distinct()  # far enough up, only a loop's members are left
    return up.join(reached, "id", "left_semi").select(*_issue("venue-parent-cycle", F.col("id"), F.col("to")))


def primary_source(events: DataFrame, citations: DataFrame, id_col: str, primary: str, source: str) -> DataFrame:
    """Events whose primary source is none of those that they cite."""
    cited = citations.select(id_col, F.col(source).alias(primary)).distinct()
    return events.where(F.col(primary).isNotNull()).join(cited, [id_col, primary], "left_anti").select(*_issue("primary-source", F.col(id_col), F.col(primary)))


def verified_before_checked(events: DataFrame, citations: DataFrame, id_col: str, verified: str, checked: str) -> DataFrame:
    latest = citations.groupBy(id_col).agg(F.max(checked).alias("latest"))
    return events.join(latest, id_col).where(F.col("latest") > F.col(verified)).select(*_issue("verification-date", F.col(id_col), F.col("latest")))


def entity_conflicts(published: DataFrame, candidate: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Entities that a candidate states otherwise than they are published, and in which columns."""
    p, c = (df.select(key, F.struct(*columns).alias(side)) for df, side in ((published, "p"), (candidate, "c")))
    differ = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"p.{x}").eqNullSafe(F.col(f"c.{x}")), F.lit(x)) for x in columns))), " ")
    return p.join(c, key).withColumn("differ", differ).where("differ != ''").select(*_issue("entity-conflict", F.col(key), F.col("differ")))


def already_there(published: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    return candidate.join(published.select(key), key, "left_semi").select(*_issue("event-exists", F.col(key), F.col(key)))


def report(checks: DataFrame) -> DataFrame:
    """How many issues of each code there are, and whether the catalogue passes (no errors). The issues are counted where they are found; what is looked at whole is a row a code."""
    counts = checks.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return counts.withColumn("passes", ~F.max(F.coalesce(F.col("severity") == "error", F.lit(False))).over(Window.partitionBy(F.lit(0))))
