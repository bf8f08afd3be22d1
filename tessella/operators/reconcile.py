"""From observations to published events: routes, held slots, folded proposals, merged calendars, candidates, integrity.

Everything is grouped aggregates, joins and windows by event or slot; a list is never larger than one event's sessions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.storage import dealt

from .places import unique_names

#: Why an observation makes no event.
NO_TITLE, NO_DATE, PAST, OUTSIDE, CANCELLED, UNKNOWN_PLACE, AMBIGUOUS_PLACE, THIN_PLACE, UNKNOWN_SOURCE = (
    "sin título", "sin fecha", "fecha pasada", "fuera de ventana", "cancelado", "lugar no reconocido", "lugar ambiguo", "lugar nuevo con datos insuficientes", "fuente desconocida",
)
ROUTES = ("ambiguous", "existing", "shared", "skipped", "not-created", "excluded", "fresh")


def route(action: Column, skip: Column, status: Column, eligibility: Column) -> Column:
    """Where an observation goes: first hit wins."""
    out = F.when(action == "ambiguous", "ambiguous").when(action == "matched", "existing").when(action == "matched-many", "shared")
    return out.when(skip.isNotNull(), "skipped").when(status == "cancelled", "not-created").when(eligibility != "include", "excluded").otherwise("fresh")


def held_groups(rows: DataFrame, group: str, route_col: str = "route") -> DataFrame:
    """Rows with ``held``: their group has an ambiguous one, so none of it is written."""
    bad = rows.groupBy(group).agg(F.max((F.col(route_col) == "ambiguous").cast("int")).alias("bad"))
    return rows.join(bad, group).withColumn("held", F.col("bad") == 1).drop("bad")


def skip_reason(title: Column, dates: Column, today: str, last: str) -> Column:
    """Why an observation can't be an event yet: no title, no date, all dates past, none inside the window."""
    first_ok = F.exists(dates, lambda d: d >= F.lit(today).cast("date"))
    inside = F.exists(dates, lambda d: d.between(F.lit(today).cast("date"), F.lit(last).cast("date")))
    out = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", NO_TITLE).when(F.size(dates) == 0, NO_DATE)
    return out.when(~first_ok, PAST).when(~inside, OUTSIDE)


def place_reason(n_known: Column, name: Column, municipality: Column, address: Column) -> Column:
    """Why a place can't be used: several known ones, none and no name, or a new one that is told too thinly."""
    told = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    out = F.when(n_known == 1, F.lit(None)).when(n_known > 1, AMBIGUOUS_PLACE).when(~told(name), UNKNOWN_PLACE)
    return out.when(~(told(municipality) & told(address)), THIN_PLACE)


def publishable(occurrences: DataFrame, date: str, today: str, last: str, moved: str | None = None, existing: str | None = None) -> DataFrame:
    """Sessions to come inside the window; one whose date a detail page moved counts for events that exist already only."""
    out = occurrences.where(F.col(date).between(F.lit(today).cast("date"), F.lit(last).cast("date")))
    return out if moved is None else out.where(~F.col(moved) | F.col(existing))


def slot_holds(members: DataFrame, group: str, slot: Sequence[str], music: str) -> DataFrame:
    """(group, kind): groups that share an exclusive slot with another group that tells of no common music.

    ``music`` is a comparable fact (null: unknown). A slot with groups of different known music is a conflict, one where it is
    unknown for some asks for review; a group's worst kind stands. One aggregate a slot, no pairs.
    """
    each = members.groupBy(*slot, group).agg(F.min(music).alias("m"))
    slots = each.groupBy(*slot).agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("m").alias("kinds"), F.count("m").alias("known"))
    kind = F.when(F.col("kinds") > 1, "conflict").when(F.col("known") < F.col("groups"), "review")
    bad = slots.where("groups > 1").select(*slot, kind.alias("kind")).where("kind is not null")
    return each.join(bad, list(slot)).groupBy(group).agg(F.min("kind").alias("kind"))  # conflict comes before review


def schedule_conflicts(rows: DataFrame, group: str, source: str, date: str, time: str) -> DataFrame:
    """(group, date, clocks): dates for which a group's sources give different times and no source gives them all."""
    stated = rows.where(F.col(time).isNotNull()).select(group, source, date, time).distinct()
    own = stated.groupBy(group, date, source).agg(F.count(F.lit(1)).alias("own"))
    clocks = stated.groupBy(group, date).agg(F.countDistinct(time).alias("clocks"), F.countDistinct(source).alias("sources"))
    most = own.groupBy(group, date).agg(F.max("own").alias("most"))
    return clocks.where("clocks > 1 and sources > 1").join(most, [group, date]).where("most < clocks").select(group, date, "clocks")


def group_conflict(rows: DataFrame, group: str, facts: Sequence[str]) -> DataFrame:
    """(group, fields): groups whose members state different values of a fact, and of which."""
    named = [F.when(F.countDistinct(c) > 1, c) for c in facts]
    out = rows.groupBy(group).agg(F.array_join(F.array_compact(F.array(*named)), " ").alias("fields"))
    return out.where("fields != ''")


def fold_proposals(rows: DataFrame, key: str, order: Sequence[str], scalars: Sequence[str], lists: Sequence[str], access: str = "access") -> DataFrame:
    """One proposal a key: of each field the last stated value by ``order``, of lists the last that has something, access never back to unknown."""
    place = F.struct(*order)
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, place)).alias(c)
    known = F.max_by(F.when(F.col(access) != "unknown", F.col(access)), F.when(F.col(access) != "unknown", place))
    return rows.groupBy(key).agg(*(last(c, F.coalesce(F.col(c) != "", F.lit(False))) for c in scalars), *(last(c, F.size(c) > 0) for c in lists), F.coalesce(known, F.lit("unknown")).alias(access))


def sides(published: DataFrame, incoming: DataFrame, key: str, date: str, time: str, ident: str) -> DataFrame:
    """Sessions of both sides in one frame; ``_new`` is 1 for incoming ones, which have no ident."""
    p = published.select(key, ident, date, time, F.lit(0).alias("_new"))
    return p.unionByName(incoming.select(key, F.lit(None).cast(published.schema[ident].dataType).alias(ident), date, time, F.lit(1).alias("_new")))


def matched(rows: DataFrame, key: str, date: str, time: str, ident: str, parts: int = 0) -> DataFrame:
    """Distinct rows of ``sides`` with ``change`` (null: the row is none of the merged sessions) and ``_told``, the time after merging.

    Rows are dealt by event and day once and sorted once; all questions are windows over that order.
    """
    day, at = Window.partitionBy(key, date), Window.partitionBy(key, date, time)
    order = Window.partitionBy(key, date).orderBy(time, "_new", ident)
    this = F.struct(time, "_new", ident)
    rows = dealt(rows, parts, key, date).withColumn("_same", F.lag(this).over(order).eqNullSafe(this)).where("not _same").drop("_same")
    old, new = F.col("_new") == 0, F.col("_new") == 1
    rows = rows.withColumns({
        "_p": F.sum(1 - F.col("_new")).over(day), "_n": F.sum("_new").over(day), "_p_time": F.min(F.when(old, F.col(time))).over(day), "_n_time": F.min(F.when(new, F.col(time))).over(day),
        "_p_at": F.min("_new").over(at) == 0, "_n_at": F.max("_new").over(at) == 1,
    })
    one = (F.col("_p") == 1) & (F.col("_n") == 1)
    placed, known = F.col(key).isNotNull() & F.col(date).isNotNull(), F.col(time).isNotNull()
    vague = F.when(one & F.col("_n_time").isNotNull(), "refined").when(one, "exact").otherwise("kept")
    gone = (known & F.col("_p_at")) | (one & (F.col("_p_time").isNull() | ~known))
    change = F.when(old & known, F.when(F.col("_n_at") & placed, "exact").otherwise("kept")).when(placed & old, vague).when(placed & ~gone, "new")
    told = F.when(old & ~known, F.when(one, F.col("_n_time"))).otherwise(F.col(time))
    return rows.withColumns({"change": change, "_told": told}).drop("_p", "_n", "_p_time", "_n_time", "_p_at", "_n_at")


def merge_occurrences(published: DataFrame, incoming: DataFrame, key: str, date: str, time: str, ident: str, parts: int = 0) -> DataFrame:
    """(key, ident, date, time, change) of every session after merging.

    Exact date and time first; then a published session of unknown time takes the time of the only incoming one that day;
    an incoming one of unknown time is what the day's only published one is; what is left over is kept, what is new has no ident yet.
    """
    rows = matched(sides(published, incoming, key, date, time, ident), key, date, time, ident, parts).where("change is not null")
    return rows.select(key, ident, date, F.col("_told").alias(time), "change")


def calendar_plan(published: DataFrame, proposed: DataFrame, changes: DataFrame, scopes: DataFrame, key: str, ident: str, date: str, today: str, parts: int = 0) -> DataFrame:
    """(key, ident, date, action) by evidence: a key's sessions as its calendar says, or "review" and no change.

    ``changes``: (key, from, to) moves that the source states; ``scopes``: (key, first, last) of ranges it vouches for. A move is applied
    if one published session is at its origin and one proposed at its destination; moves of past sessions and moves already made are
    no moves; two moves of one origin or to one destination make the key ask for review. Then equal dates are matched; the rest of
    the proposed get a new ident; the rest of the published are dropped only if they are to come and inside a scope.

    Scopes (a), published (p) and proposed (q) sessions and moves are dealt by key once; a move is asked about at its origin (f), then at its destination (t).
    """
    now = F.lit(today).cast("date")
    none = F.lit(None).cast(published.schema[ident].dataType)
    row = lambda df, on, other, kind, told: df.select(key, F.col(on).alias("_day"), other.cast("date").alias("_other"), told.alias("_ident"), F.lit(kind).alias("_kind"))
    moves = changes.where(F.col("from") != F.col("to"))
    rows = row(scopes, "first", F.col("last"), "a", none).unionByName(row(published, date, F.lit(None), "p", F.col(ident))).unionByName(row(proposed, date, F.lit(None), "q", none)).unionByName(row(moves, "from", F.col("to"), "f", none))
    is_ = lambda kind: F.col("_kind") == kind
    count = lambda ok, over: F.sum(F.when(ok, 1).otherwise(0)).over(over)
    day, origin = Window.partitionBy(key, "_day"), Window.partitionBy(key, "_from")
    order = Window.partitionBy(key).orderBy("_day", "_kind", "_other")
    # a scope comes before all else of its first day, and equal moves stand together
    rows = dealt(rows, parts, key).withColumns({"_until": F.max(F.when(is_("a"), F.col("_other"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_before": F.lag(F.struct("_day", "_kind", "_other")).over(order)})
    rows = rows.withColumn("_again", F.coalesce(F.col("_before") == F.struct("_day", "_kind", "_other"), F.lit(False))).where(~is_("a") & ~(is_("f") & F.col("_again"))).drop("_before")
    rows = rows.withColumns({"_p": count(is_("p"), day), "_q": count(is_("q"), day), "_f": count(is_("f"), day)})
    rows = rows.where(~is_("f") | ((F.col("_day") >= now) & (F.col("_p") > 0)))  # past ones stay, made ones are made
    rows = rows.withColumns({"_from": F.col("_day"), "_several": ~is_("f") & ((F.col("_p") > 1) | (F.col("_q") > 1)), "_odd": is_("f") & ((F.col("_f") > 1) | (F.col("_p") > 1))})
    rows = rows.withColumns({"_day": F.when(is_("f"), F.col("_other")).otherwise(F.col("_day")), "_kind": F.when(is_("f"), "t").otherwise(F.col("_kind"))})
    rows = rows.withColumns({"_targets": count(is_("q"), day), "_t": count(is_("t"), day)})
    rows = rows.withColumn("_odd", is_("t") & (F.col("_odd") | (F.col("_t") > 1) | (F.col("_targets") != 1)))
    rows = rows.withColumns({"_made": F.coalesce(F.max(is_("t") & ~F.col("_odd")).over(day), F.lit(False)), "_review": F.max(F.col("_odd") | F.col("_several")).over(Window.partitionBy(key)) & F.col(key).isNotNull()})
    rows = rows.withColumn("_new", F.max(F.when(is_("t") & ~F.col("_odd"), F.col("_day"))).over(origin))
    scoped = F.coalesce((F.col("_until") >= F.col("_day")) & (F.col("_day") >= now), F.lit(False))
    kept = F.when(F.col("_review"), "review").when(F.col("_new").isNotNull(), "moved").when((F.col("_q") > 0) & F.col("_day").isNotNull(), "kept").when(scoped, "dropped").otherwise("kept")
    taken = F.col("_made") | ((F.col("_p") > 0) & F.col("_day").isNotNull())
    rows = rows.where(is_("p") | (is_("q") & ~F.col("_again") & ~taken & ~F.col("_review")))
    moved = F.when(is_("p") & ~F.col("_review"), F.col("_new"))
    return rows.select(key, F.col("_ident").alias(ident), F.coalesce(moved, F.col("_day")).alias(date), F.when(is_("p"), kept).otherwise("new").alias("action"))


def place_to_publish(published: Column, incoming: Column, relation: Column) -> Column:
    """The incoming place, unless it is none or only the building of a published room (``relation`` as linkage.venue_relation from incoming to published)."""
    return F.when(incoming.isNull() | (relation == "coarser"), published).otherwise(incoming)


def with_idents(fresh: DataFrame, name: Column, taken: DataFrame, column: str, order: Sequence[str], most: int = 120) -> DataFrame:
    """Allocates idents in order: a name that is free as it is, else with a number; no two are the same, whatever names end in numbers of their own."""
    return unique_names(fresh, name, taken, column, order, most=most)


def integrity(planned: DataFrame, candidates: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Keys that a plan, its candidates and what was written don't all have exactly once."""
    sides = [df.groupBy(key).agg(F.count(F.lit(1)).alias(c)) for df, c in ((planned, "planned"), (candidates, "candidates"), (written, "written"))]
    out = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer").fillna(0, ["planned", "candidates", "written"])
    return out.where("planned != 1 or candidates != 1 or written != 1")


def publication(fatal: Column, review: Column, changes: Column, deletes: Column) -> Column:
    """What a run may do: nothing after a fatal reason or with deletions, no-op without changes, a draft if something is to be looked at."""
    return F.when(fatal | (deletes > 0), "abort").when(changes == 0, "no-op").when(review, "publish-draft").otherwise("publish")


def outcome(action: Column, change: Column, status: Column, skip: Column, eligibility: Column) -> Column:
    """The one outcome of an observation: first hit wins."""
    out = F.when(action == "ambiguous", "ambiguous").when(change == "created", "created").when(change == "updated", "updated").when(change == "unchanged", "unchanged")
    out = out.when(status == "cancelled", "cancelled-not-created").when(skip.isNotNull(), "structural-skip")
    return out.when(eligibility == "exclude", "excluded").when(eligibility == "uncertain", "uncertain").otherwise("structural-skip")


def persisted(incoming: Mapping[str, Column], published: Mapping[str, Column], seen: Column, last_seen: Column, days: int = 30) -> Column:
    """Whether a row is worth writing: a fact differs, or all are equal and the verification is ``days`` older than now."""
    differs = F.lit(False)
    for c, value in incoming.items():
        differs = differs | ~value.eqNullSafe(published[c])
    return differs | (seen >= F.date_add(last_seen, days))
