"""How a run went: every finding with its level, the worst of them, and whether the run may merge itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("clean", "degraded", "review", "fatal")
#: Counters of a run, in the order in which they are told, and the finding of a counter above zero with its level.
COUNTERS: tuple[tuple[str, str, str], ...] = (
    ("ambiguous", "ambiguous", "review"), ("classification_drift", "classification-drift", "review"), ("batch_duplicates", "batch-duplicates", "review"), ("possibly_missing", "possibly-missing", "degraded"), ("source_conflicts", "source-conflict", "review"),
    ("hydration_failed", "hydration-failed", "degraded"), ("ai_uncertain", "ai-uncertain", "degraded"), ("ai_rate_limited", "ai-rate-limited", "degraded"), ("ai_timeout", "ai-timeout", "degraded"), ("ai_deferred", "ai-deferred", "degraded"), ("ai_error", "ai-error", "degraded"),
    ("ai_invalid_output", "ai-invalid-output", "degraded"), ("ai_malformed_output", "ai-malformed-output", "degraded"), ("ai_incomplete", "ai-incomplete", "degraded"), ("unresolved_taxonomy", "unresolved-taxonomy", "degraded"), ("unresolved_composers", "unresolved-composers", "degraded"),
)


def findings(runs: DataFrame, sources: DataFrame, run: str, source: str, needs_source: bool = True) -> DataFrame:
    """(run, place, reason, level): every finding of every run.

    runs: ``batch_ok``, ``fatal`` (an array of reasons) and counters, of which missing ones count as 0. sources: ``usable``, ``extracted``, ``hydration_severe`` and ``coverage`` (complete, partial, stale or null).
    A run without a usable source is fatal where one is needed. Sources are told by name, each finding once.
    """
    there = [c for c in COUNTERS if c[0] in runs.columns]
    usable = sources.groupBy(run).agg(F.max(F.col("usable").cast("int")).alias("_usable"))
    facts = runs.join(usable, run, "left")
    one = lambda place, reason, level: F.struct(F.lit(place).alias("place"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(level).alias("level"))
    own = [F.when(~F.coalesce("batch_ok", F.lit(False)), one(0, "invalid-batch", "fatal"))]
    if needs_source:
        own.append(F.when(F.coalesce("_usable", F.lit(0)) == 0, one(1, "no-sources-succeeded", "fatal")))
    own += [F.when(F.coalesce(c, F.lit(0)) > 0, one(10 + i, reason, level)) for i, (c, reason, level) in enumerate(there)]
    each = F.concat(F.array_compact(F.array(*own)), F.transform(F.coalesce("fatal", F.array().cast("array<string>")), lambda r: one(2, r, "fatal")))
    of_runs = facts.select(run, F.explode(each).alias("f"))
    name = F.col(source).cast("string")
    of_source = F.array_compact(F.array(
        F.when(F.col("coverage").isNotNull() & (F.col("coverage") != "complete"), one(3, F.concat(F.lit("source-coverage-"), "coverage", F.lit(":"), name), "degraded")),
        F.when(~F.coalesce("extracted", F.lit(False)), one(4, F.concat(F.lit("source-failed:"), name), "review")), F.when(F.coalesce("hydration_severe", F.lit(False)), one(5, F.concat(F.lit("source-hydration-incomplete:"), name), "review")),
    ))
    of_sources = sources.select(run, F.explode(of_source).alias("f"))
    return of_runs.union(of_sources).select(run, "f.*").distinct()


def evaluated(runs: DataFrame, found: DataFrame, run: str) -> DataFrame:
    """(run, health, auto_merge, findings, reasons): the worst level, whether it is clean or degraded, how many findings there are, and the reasons without sources' names, each once, in order."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    bare = F.split_part("reason", F.lit(":"), F.lit(1))
    each = found.groupBy(run, "place", bare.alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("rank"))
    summed = each.groupBy(run).agg(F.max("rank").alias("_rank"), F.sum("n").alias("findings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bare"))), lambda x: x["bare"]), " ").alias("reasons"))
    out = runs.select(run).join(summed, run, "left")
    worst = F.coalesce("_rank", F.lit(1))
    return out.select(run, F.element_at(F.array(*map(F.lit, LEVELS)), worst.cast("int")).alias("health"), (worst <= 2).alias("auto_merge"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("reasons", F.lit("")).alias("reasons"))
