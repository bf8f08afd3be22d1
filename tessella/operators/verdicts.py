"""Verdicts over the pairs of rows that share a block: slots that several events hold, groups with members that contradict each other.

A verdict (say match, conflict or insufficient) is no equivalence, so no key tells which rows of a block have a partner of some kind.
What keeps a hot block in bounds:

1. Rows are dealt by block once, as they are, a hot block in several parts; in each part every row is held against a few of its distinct facts, the witnesses,
   until one gives it the heaviest verdict that it can get at all. That settles it. A part whose facts are all witnesses is done too.
2. The open ones meet all distinct facts of their block in tiles: a cell of the (open x all) square has ``tile_rows`` rows a side at most and goes to a
   task by itself; pairs are judged where they meet and leave as one row for each left side and verdict.

Facts travel and are stored as they are told, in compressed columns; what verdicts ask of them is made where they are judged, as it is many times as large.

So a block in which facts mostly contradict each other, or one of copies, costs a multiple of its rows; only facts that agree with all
witnesses are compared with everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import once
from tessella.sources.storage import kept, tasks

Verdict = Callable[[Column, Column], Column]
Prepare = Callable[[Column], Column]
WITNESSES, TILE_ROWS, PART_ROWS = 16, 512, 20_000


def _sides(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _others(lo: Column, hi: Column, group: Column) -> Column:
    """Some group from lo to hi is another than this one."""
    return ~lo.eqNullSafe(group) | ~hi.eqNullSafe(group)


def _met(rows: DataFrame, block: Sequence[str], group: str, facts: Sequence[str], verdict: Verdict, decisive: str, witnesses: int, tile_rows: int, prepare: Prepare | None, heaviest: Prepare | None, part_rows: int, whole_blocks: bool = False) -> DataFrame:
    """(block, g, kinds) of groups, in some rows each: the verdicts they met, as in kinds_met. With ``whole_blocks`` open rows of blocks in which anything decisive
    was met are left at that, with no kinds."""
    b = list(block)
    known = rows.select(*b, F.col(group).alias("g"), F.struct(*facts).alias("f")).dropna(subset=[*b, "g"])
    known = kept(known.select(*b, "g", "f", *_sides("f")))
    sizes = known.groupBy(*b).agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("_lo"), F.max("g").alias("_hi"))
    hot = kept(sizes.where(F.col("n") > part_rows).select(*b, F.ceil(F.col("n") / part_rows).alias("_parts")))  # at most one in part_rows rows
    if hot.isEmpty():  # without a join that would be planned away on one side first, so that both sides below read one deal
        deal = known.withColumn("_part", F.pmod("h2", F.lit(1)).cast("int"))
    else:
        deal = known.join(F.broadcast(hot), b, "left").withColumn("_part", F.coalesce(F.pmod("h2", F.col("_parts")) + 1, F.lit(0)).cast("int"))  # 0: the whole block
    part = [*b, "_part"]
    parts = max(tasks(known), 1 + known.count() // 200_000)
    dealt = deal.select(*part, "g", "f", "h1", "h2").repartition(parts, *part)
    made = prepare or (lambda f: f)
    top = heaviest or (lambda f: F.lit(decisive))
    # witnesses: of each part the facts with the least hashes, and whether there are more
    sig = dealt.groupBy(*part, "h1", "h2").agg(F.first("f").alias("f"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    least = sig.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("h1", "h2"))).where(F.col("_r") <= witnesses + 1)
    witness = F.when(F.col("_r") <= witnesses, F.struct("f", "lo", "hi"))
    ws = least.withColumn("f", made(F.col("f"))).groupBy(*part).agg(F.collect_list(witness).alias("ws"), ((F.count(F.lit(1)) > witnesses) | (F.col("_part") > 0)).alias("more"))
    meets = lambda w: _others(w["lo"], w["hi"], F.col("g"))

    def judged(f: Column) -> Column:
        settled = F.exists("ws", lambda w: meets(w) & (verdict(f, w["f"]) == top(f)))
        whole = F.array_distinct(F.transform(F.filter("ws", meets), lambda w: verdict(f, w["f"])))
        return F.when(settled, F.array(top(f))).when(~F.col("more"), whole)

    seen = dealt.join(ws, part).withColumn("kinds", once(made(F.col("f")), judged))
    is_open = F.col("kinds").isNull()
    seen = kept(seen.select(*b, "g", "kinds", F.when(is_open, F.col("h1")).alias("h1"), F.when(is_open, F.col("h2")).alias("h2")))
    done, open_ = seen.where(F.size("kinds") > 0).select(*b, "g", "kinds"), seen.where("kinds is null").drop("kinds")
    if whole_blocks:
        over = done.where(F.array_contains("kinds", decisive)).select(*b).distinct()
        done = done.union(open_.join(over, b, "left_semi").select(*b, "g", F.array().cast("array<string>").alias("kinds")))
        open_ = open_.join(over, b, "left_anti")
    if open_.isEmpty():
        return done
    # open rows of blocks with several groups meet every fact of their block
    several = sizes.where(F.col("_lo") != F.col("_hi")).select(*b)
    open_ = open_.join(several, b, "left_semi").repartition(*b)
    lefts = open_.select(*b, "h1", "h2").distinct()
    every = known.join(lefts.select(*b).distinct(), b, "left_semi").groupBy(*b, "h1", "h2").agg(F.first("f").alias("f"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    every = kept(every.join(lefts.withColumn("_left", F.lit(True)), [*b, "h1", "h2"], "left").withColumn("_left", F.coalesce("_left", F.lit(False))))
    many = every.groupBy(*b).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_left").alias("_open"))
    every = every.join(many, b)
    tiles = lambda n: F.ceil(F.col(n) / tile_rows).cast("int")
    tile = lambda n: F.pmod(F.col("h1"), tiles(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    left = every.where("_left").select(*b, "h1", "h2", F.col("f").alias("x"), tile("_open").alias("_i"), across("_n").alias("_j"))
    right = every.select(*b, F.col("f").alias("y"), "lo", "hi", tile("_n").alias("_j"), across("_open").alias("_i"))
    cell = [*b, "_i", "_j"]
    left, right = (side.repartition(*cell).withColumn(c, made(F.col(c))) for side, c in ((left, "x"), (right, "y")))
    pairs = left.join(right, cell)  # a row's own facts too, which other groups may have
    told = pairs.groupBy(*b, "h1", "h2", verdict(F.col("x"), F.col("y")).alias("kind")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = open_.join(told, [*b, "h1", "h2"]).where(_others(F.col("lo"), F.col("hi"), F.col("g")))
    return done.union(found.select(*b, "g", F.array("kind").alias("kinds")))


def kinds_met(rows: DataFrame, block: Sequence[str], group: str, facts: Sequence[str], verdict: Verdict, decisive: str = "conflict", witnesses: int = WITNESSES, tile_rows: int = TILE_ROWS, prepare: Prepare | None = None, heaviest: Prepare | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(block, group, kinds): the verdicts that rows of a group get with rows of other groups in their block, as a sorted array.

    ``verdict`` takes two structs of ``facts`` and is symmetric. Where ``decisive`` is among the kinds others may be missing; they are
    complete where it isn't. Blocks and groups that are null take part in nothing; a block of one group gives no row. With ``prepare`` the
    verdict takes what that makes of the structs. ``heaviest`` tells, of (prepared) facts, the heaviest kind that they can get with any others, where that
    isn't ``decisive``: once they have met it, lighter ones may be missing.
    """
    met = _met(rows, block, group, facts, verdict, decisive, witnesses, tile_rows, prepare, heaviest, part_rows)
    return met.groupBy(*block, F.col("g").alias(group)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")).where(F.size("kinds") > 0)


def _has(kind: str) -> Column:
    return F.max(F.array_contains("kinds", kind).cast("int")) == 1


def slot_collisions(rows: DataFrame, slot: Sequence[str], ident: str, facts: Sequence[str], verdict: Verdict, prepare: Prepare | None = None) -> DataFrame:
    """(slot, n, first, code) of slots that several idents hold: schedule-conflict if any two conflict, else schedule-duplicate if any
    two match, else schedule-review."""
    met = _met(rows, slot, ident, facts, verdict, "conflict", WITNESSES, TILE_ROWS, prepare, None, PART_ROWS, whole_blocks=True)
    met = met.groupBy(*slot, F.col("g").alias(ident)).agg(F.array(*(F.when(_has(k), k) for k in ("conflict", "match"))).alias("kinds"))
    code = F.when(_has("conflict"), "schedule-conflict").when(_has("match"), "schedule-duplicate").otherwise("schedule-review")
    return met.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first"), code.alias("code"))


def held(rows: DataFrame, slot: Sequence[str], group: str, facts: Sequence[str], verdict: Verdict, prepare: Prepare | None = None, heaviest: Prepare | None = None) -> DataFrame:
    """(group, kind): groups that share a slot with a group they contradict (conflict), or one that nothing is known to tell them from (review)."""
    met = _met(rows, slot, group, facts, verdict, "conflict", WITNESSES, TILE_ROWS, prepare, heaviest, PART_ROWS)
    out = met.groupBy(F.col("g").alias(group)).agg(F.when(_has("conflict"), "conflict").when(_has("insufficient"), "review").alias("kind"))
    return out.where("kind is not null")


def contradicted(rows: DataFrame, group: str, source: Sequence[str], ident: str, facts: Sequence[str], verdict: Verdict, prepare: Prepare | None = None, heaviest: Prepare | None = None) -> DataFrame:
    """(group, reason): groups with two members of one source identity that are incompatible, or need review (the first stands)."""
    met = _met(rows, [group, *source], ident, facts, verdict, "incompatible", WITNESSES, TILE_ROWS, prepare, heaviest, PART_ROWS)
    reason = F.when(_has("incompatible"), "source-identity-conflict").when(_has("review"), "source-identity-review")
    return met.groupBy(group).agg(reason.alias("reason")).where("reason is not null")
