"""An event's sessions after a source has told its calendar: which published session is which proposed one, with dates and times.

All questions are about one day of one event (or one session of it), so rows of both sides and both ends of every stated move are put together once
and asked by windows over (event, day). What a change is found to be, the scopes and which events need review then meet an event's
sessions in windows over the event, whose rows are sorted outside of memory where they are many.

Frames have a key, ``date``, ``time`` (text, null: unknown) and, if published, an ident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.storage import dealt

from . import reconcile


def _count(when: Column, over: Column) -> Column:
    return F.sum(when.cast("int")).over(over)


def _rows(published: DataFrame, proposed: DataFrame, changes: DataFrame, key: str, ident: str) -> DataFrame:
    """Published (p) and proposed (n) sessions, origins (f) and destinations (t) of moves, in one frame."""
    kind = published.schema[ident].dataType
    p = published.select(key, "date", "time", F.lit("p").alias("kind"), ident, F.lit(None).cast("int").alias("order"), F.lit(None).cast("date").alias("other"))
    n = proposed.select(key, "date", "time", F.lit("n").alias("kind"), F.lit(None).cast(kind).alias(ident), F.lit(None).cast("int").alias("order"), F.lit(None).cast("date").alias("other")).distinct()
    end = lambda side, there, tag: changes.select(key, F.col(f"{side}_date").alias("date"), F.col(f"{side}_time").alias("time"), F.lit(tag).alias("kind"), F.lit(None).cast(kind).alias(ident), F.col("order").cast("int").alias("order"), F.col(f"{there}_date").alias("other"))
    return p.unionByName(n).unionByName(end("from", "to", "f")).unionByName(end("to", "from", "t"))


def planned(published: DataFrame, proposed: DataFrame, changes: DataFrame, scopes: DataFrame, key: str, ident: str, today: str, parts: int = 0) -> DataFrame:
    """(key, ident, date, time, action, place): every session after a plan, or as it was with "review" where the plan isn't certain.

    ``changes``: (key, order, from_date, from_time, to_date, to_time), moves that the source states, distinct and in order; a null from_time is any of the day.
    ``scopes``: (key, first, last), the days for which the source tells all sessions; one a key. Stages, each on what the ones before left:

    1. A move is applied ("moved") if one published session is at its origin, none at its destination and one proposed there. Moves of past
       sessions stay unapplied, and so do those made already. Origins that meet, or two moves to one session, ask for review.
    2. Equal date and time ("kept"). 3. On a day to come with one session left on either side, the published one takes the proposed
       time ("timed"), if its own is unknown or the day is in scope; more than one on a side asks for review.
    4. What is left of the proposed is "new", with its ``place`` after all published ones; what is left of the published is "dropped" if it is to come and in scope, else "kept".
    """
    now = F.lit(today).cast("date")
    rows = dealt(_rows(published, proposed, changes, key, ident).withColumn("_t", F.coalesce("time", F.lit(""))), parts, key, "date").sortWithinPartitions(key, "date", "_t")  # one order for all windows
    day, at = Window.partitionBy(key, "date"), Window.partitionBy(key, "date", "_t")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    vague = is_("f") & F.col("time").isNull()
    rows = rows.withColumns({
        "_any": F.min(F.when(vague, F.col("order"))).over(day), "_vague": _count(vague, day), "_f_day": _count(is_("f"), day), "_f_at": _count(is_("f"), at), "_p_day": _count(is_("p"), day),
        "_p_at": _count(is_("p"), at), "_n_at": _count(is_("n"), at), "_t_at": _count(is_("t"), at), "_t_order": F.min(F.when(is_("t"), F.col("order"))).over(at), "_exact": F.min(F.when(is_("f") & ~vague, F.col("order"))).over(at),
    })
    rows = rows.withColumn("_origin", F.coalesce("_exact", "_any"))  # the move that a published session here would make
    clash = F.when(is_("f"), ((F.col("_vague") > 0) & (F.col("_f_day") > 1)) | (F.col("_f_at") > 1)).otherwise(F.col("_t_at") > 1)
    free = F.col("_origin").isNotNull() & ((F.col("_origin") == F.col("order")) | ((F.col("_origin") < F.col("order")) & (F.col("date") >= now)))
    stated = rows.where(is_("f", "t")).groupBy(key, "order").agg(
        F.max(F.when(is_("f"), F.when(vague, F.col("_p_day")).otherwise(F.col("_p_at")))).alias("o"), F.max(F.when(is_("t"), F.when(free, 0).otherwise(F.col("_p_at")))).alias("pd"), F.max(F.when(is_("t"), F.col("_n_at"))).alias("nd"),
        F.max(F.when(is_("f"), F.col("date"))).alias("from_date"), F.max(F.when(is_("t"), F.col("date"))).alias("to_date"), F.max(clash).alias("clash"), F.max(F.when(is_("t"), F.col("time"))).alias("to_time"),
    )
    o, pd, nd = (F.col(c) for c in ("o", "pd", "nd"))
    past_odd = (o == 0) & (((pd != 1) & (nd != 1)) | (pd > 1))
    odd = (o > 1) | (pd > 1) | ((o == 0) & (pd != 1) & ~((F.col("to_date") >= now) & (nd == 1))) | ((o == 1) & ((nd != 1) | (pd == 1)))
    stated = stated.withColumns({"_asks": F.col("clash") | F.when(F.col("from_date") < now, past_odd).otherwise(odd), "_made": (F.col("from_date") >= now) & (o == 1)})
    told = stated.select(key, F.lit("m").alias("kind"), F.col("order").alias("_c"), F.col("to_date").alias("_to"), F.col("to_time").alias("_to_time"), (F.col("_made") & ~F.col("_asks")).alias("_made"), "_asks")
    here = rows.where(is_("p", "n")).select(key, "date", "time", "_t", "kind", ident, F.when(is_("p"), F.col("_origin")).otherwise(F.col("_t_order")).alias("_c"))
    here = here.unionByName(told, allowMissingColumns=True).unionByName(scopes.select(key, F.lit("s").alias("kind"), F.col("first").alias("_first"), F.col("last").alias("_last")), allowMissingColumns=True)
    # what moves, scopes and reviews say goes to an event's sessions, dealt by event from here on
    move, event = Window.partitionBy(key, "_c"), Window.partitionBy(key)
    known = F.col(key).isNotNull()
    top = lambda c, over: F.max(c).over(over)
    here = dealt(here, parts, key).withColumns({
        "_moved": F.coalesce(top("_made", move), F.lit(False)) & known & F.col("_c").isNotNull(), "_to": top("_to", move), "_to_time": top("_to_time", move), "_first": F.when(known, top("_first", event)), "_last": F.when(known, top("_last", event)),
        "_asked": F.coalesce(top("_asks", event), F.lit(False)), "_many": F.when(known, _count(is_("p"), event)),
    }).where(is_("p", "n")).sortWithinPartitions(key, "date", "_t", "kind", "_moved", ident)
    here = here.withColumn("_scope", F.coalesce(F.col("date").between(F.col("_first"), F.col("_last")), F.lit(False)))
    open_ = ~F.col("_moved")
    here = here.withColumns({"_ps": _count(is_("p") & open_, at), "_ns": _count(is_("n") & open_, at), "_rank": F.row_number().over(Window.partitionBy(key, "date", "_t", "kind", "_moved").orderBy(ident))})
    here = here.withColumn("_exact", open_ & F.when(is_("p"), (F.col("_ns") > 0) & (F.col("_rank") == 1)).otherwise(F.col("_ps") > 0))
    left = open_ & ~F.col("_exact")
    able = is_("p") & left & (F.col("date") >= now) & (F.col("_scope") | F.col("time").isNull())
    new_time = F.max(F.when(is_("n") & left, F.col("time"))).over(day)
    here = here.withColumns({"_able": able, "_cand": _count(able, day), "_un": _count(is_("n") & left, day), "_new_time": new_time, "_left": left})
    pair = (F.col("_cand") == 1) & (F.col("_un") == 1) & (F.col("_scope") | F.col("_new_time").isNotNull())
    here = here.withColumns({"_timed": F.col("_left") & pair & (F.col("_able") | is_("n")), "_odd": is_("n") & F.col("_left") & (F.col("_cand") > 0) & ((F.col("_cand") != 1) | (F.col("_un") != 1))})
    here = here.withColumn("_review", (F.col("_asked") | F.coalesce(top("_odd", event), F.lit(False))) & known)
    action = F.when(is_("n"), "new").when(F.col("_review"), "review").when(F.col("_moved"), "moved").when(F.col("_exact"), "kept").when(F.col("_timed"), "timed").when((F.col("date") >= now) & F.col("_scope"), "dropped").otherwise("kept")
    out = here.where(is_("p") | (F.col("_left") & ~F.col("_timed") & ~F.col("_review"))).withColumn("action", action)
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.col("date").asc(), F.col("time").asc_nulls_first()))
    told = lambda c, moved, timed: F.when(F.col("action") == "moved", moved).when(F.col("action") == "timed", timed).otherwise(F.col(c)).alias(c)
    place = F.when(is_("n"), F.coalesce("_many", F.lit(0)) + nth).cast("long").alias("place")
    return out.select(key, ident, told("date", F.col("_to"), F.col("date")), told("time", F.col("_to_time"), F.col("_new_time")), "action", place)


def merged(published: DataFrame, incoming: DataFrame, status: DataFrame, key: str, ident: str, parts: int = 0) -> DataFrame:
    """(key, ident, date, time, change, status): sessions after an observation without a calendar of its own.

    ``status``: (key, was, now), the event's and the observation's. Where either is postponed and both tell of one session, it is the same
    one with a new date and time ("moved"); all others merge by date and time (reconcile.merge_occurrences). Sessions of what is now cancelled are cancelled; what wasn't there before is scheduled.
    """
    rows = reconcile.sides(published, incoming, key, "date", "time", ident)
    old, new = F.when(F.col("_new") == 0, F.struct(ident, "date", "time")), F.when(F.col("_new") == 1, F.struct("date", "time"))
    ends = rows.groupBy(key).agg(F.min(old).alias("_p"), F.max(old).alias("_p2"), F.min(new).alias("_to"), F.max(new).alias("_n2"))
    put_off, off = (F.col("was") == "postponed") | (F.col("now") == "postponed"), F.coalesce(F.col("now") == "cancelled", F.lit(False))
    one = (F.col("_p") == F.col("_p2")) & (F.col("_to") == F.col("_n2"))  # both sides are there, and of one session
    events = ends.join(status, key).select(key, F.when(put_off & one, F.col("_to")).alias("_to"), off.alias("_off"))
    rows = reconcile.matched(rows.join(events, key, "left"), key, "date", "time", ident, parts)
    moved = F.col("_to").isNotNull()
    rows = rows.withColumn("change", F.when(moved, F.when(F.col("_new") == 0, "moved")).otherwise(F.col("change"))).where("change is not null")
    told = lambda c, stays: F.when(moved, F.col(f"_to.{c}")).otherwise(F.col(stays)).alias(c)
    gone = F.coalesce("_off", F.lit(False)) & (F.col("change") != "new")
    return rows.select(key, ident, told("date", "date"), told("time", "_told"), "change", F.when(gone, "cancelled").otherwise("scheduled").alias("status"))
