"""Pair verdicts in parts of blocks: hot blocks dealt in several, rows settled by the heaviest verdict they can get, and what all this stores."""

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import verdicts

from .test_verdicts import brute, judge


def rows_of(seed, n=400, values=14):
    r = random.Random(seed)
    hot = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([*range(60), None]), r.randrange(values)) for _ in range(n)]
    return [*hot, ("alone", 1, 3), ("alone", 1, 9), *(("alone too", 1, v) for v in range(40)), ("two", 1, 3), ("two", 2, 3)]


def stored(spark):
    """Bytes in the shared folder."""
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())


def wide(spark, blocks, a_block):
    """Rows whose facts get 4 KB each once they are prepared."""
    return spark.range(blocks * a_block).select((F.col("id") % blocks).alias("b"), F.col("id").alias("g"), (F.floor(F.col("id") / blocks) % 3 + 1).alias("v"), F.col("id").alias("w"))


def prepare(f):
    return F.struct(f["v"].alias("v"), F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat(i, F.lit("/"), f["w"]), 256)).alias("made"))


def heaviest(f):
    return F.when(f["v"] == 0, "insufficient").otherwise("conflict")


@pytest.mark.parametrize(("part_rows", "witnesses", "tile"), [(10, 2, 7), (50, 3, 512), (20_000, 1, 5)])
def test_a_block_in_parts_against_all_pairs(spark, part_rows, witnesses, tile):
    rows = rows_of(part_rows)
    df = spark.createDataFrame(rows, "b string, g int, v int")
    met = verdicts.kinds_met(df, ["b"], "g", ["v"], judge, witnesses=witnesses, tile_rows=tile, part_rows=part_rows, heaviest=heaviest).collect()
    want = brute(rows)
    got = {(x.b, x.g): set(x.kinds) for x in met}
    assert len(met) == len(got) and got.keys() == want.keys()
    for key, kinds in want.items():
        top = "conflict" if "conflict" in kinds else "insufficient" if "insufficient" in kinds else "match"
        assert got[key] <= kinds and top in got[key]


def test_holds_are_stored_as_told(spark):
    df, before = wide(spark, 50, 60), stored(spark)
    assert verdicts.held(df, ["b"], "g", ["v", "w"], judge, prepare).collect() == []
    assert stored(spark) - before < 1_000_000


def test_a_slot_with_a_conflict_is_settled(spark):
    """Codes and numbers of slots, and that open rows of a settled slot are left at that: the facts of its block are stored once."""
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "b string, g int, v int")
    got = {x.b: (x.n, x.first, x.code) for x in verdicts.slot_collisions(df, ["b"], "g", ["v"], judge).collect()}
    met = defaultdict(set)
    for (b, _), kinds in brute(rows).items():
        met[b] |= kinds
    code = {b: "schedule-conflict" if "conflict" in k else "schedule-duplicate" if "match" in k else "schedule-review" for b, k in met.items()}
    groups = {b: {g for c, g, _ in rows if c == b and g is not None} for b in met}
    assert got == {b: (len(groups[b]), min(groups[b]), code[b]) for b in met}
    # two in three match all but the last, which conflicts with them; facts are told apart by a long word that doesn't compress
    some = spark.range(2_000).select(F.lit(1).alias("b"), F.col("id").alias("g"), (F.col("id") % 3 + 1 + F.when(F.col("id") % 50 == 0, 90).otherwise(0)).alias("v"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat(i, F.lit("/"), F.col("id")), 256)), "").alias("w"))
    before = stored(spark)
    assert [tuple(r) for r in verdicts.slot_collisions(some, ["b"], "g", ["v", "w"], judge).collect()] == [(1, 2_000, 0, "schedule-conflict")]
    assert stored(spark) - before < 4_500_000  # they have 2.6 MB


def test_small_groups_are_judged_where_they_meet(spark):
    """Groups of a few members, none of which conflict: nothing is open, and nothing is stored but what they tell."""
    df, before = wide(spark, 1_500, 3).withColumn("year", F.lit(1)), stored(spark)
    kind = lambda a, b: F.when(judge(a, b) == "conflict", "incompatible").when(judge(a, b) == "insufficient", "review").otherwise("compatible")
    assert verdicts.contradicted(df, "b", ["year"], "g", ["v", "w"], kind, prepare).collect() == []
    assert stored(spark) - before < 1_000_000
    rows = [(1, 1, 0), (1, 2, 9), (2, 3, 1), (2, 4, 9), (3, 5, 1), (3, 6, 2), (4, 7, 1), (None, 8, 1), (None, 9, 9)]
    told = spark.createDataFrame(rows, "b int, g int, v int").withColumn("year", F.lit(1))
    got = verdicts.contradicted(told, "b", ["year"], "g", ["v"], kind, heaviest=lambda f: F.when(f["v"] == 0, "review").otherwise("incompatible"))
    assert sorted(map(tuple, got.collect())) == [(1, "source-identity-review"), (2, "source-identity-conflict")]
