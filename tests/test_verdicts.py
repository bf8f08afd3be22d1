"""Pair verdicts in blocks against all pairs, with hot blocks, copies, nulls and groups of several rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import verdicts


def judge(a, b):
    """Not transitive: numbers that are close match, those far apart conflict; 0 tells nothing."""
    far = F.abs(a["v"] - b["v"])
    return F.when((a["v"] == 0) | (b["v"] == 0), "insufficient").when(far <= 2, "match").when(far > 5, "conflict").otherwise("insufficient")


def plain(a, b):
    return "insufficient" if not a or not b else "match" if abs(a - b) <= 2 else "conflict" if abs(a - b) > 5 else "insufficient"


def brute(rows):
    out = defaultdict(set)
    for b, g, v in rows:
        for c, h, w in rows:
            if None not in (b, g, h) and b == c and g != h:
                out[b, g].add(plain(v, w))
    return out


@pytest.mark.parametrize(("values", "tile", "witnesses"), [(12, 4, 1), (6, 3, 2), (3, 512, 8), (40, 5, 3)])
def test_against_all_pairs(spark, values, tile, witnesses):
    r = random.Random(values)
    rows = [(r.choice(["hot", "hot", "a", "b", "c", None]), r.choice([*range(40), None]), r.randrange(values)) for _ in range(300)] + [("alone", 1, 3), ("alone", 1, 9), ("two", 1, 3), ("two", 2, 3)]
    df = spark.createDataFrame(rows, "b string, g int, v int")
    got = {(x.b, x.g): set(x.kinds) for x in verdicts.kinds_met(df, ["b"], "g", ["v"], judge, tile_rows=tile, witnesses=witnesses).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for key, kinds in want.items():
        assert got[key] == kinds if "conflict" not in kinds else "conflict" in got[key] and got[key] <= kinds
    codes = {x.b: x.code for x in verdicts.slot_collisions(df, ["b"], "g", ["v"], judge).collect()}
    for b in {k[0] for k in want}:
        met = set().union(*(v for k, v in want.items() if k[0] == b))
        assert codes[b] == ("schedule-conflict" if "conflict" in met else "schedule-duplicate" if "match" in met else "schedule-review")
    holds = {x.g: x.kind for x in verdicts.held(df, ["b"], "g", ["v"], judge).collect()}
    by_group = defaultdict(set)
    for (_, g), kinds in want.items():
        by_group[g] |= kinds
    assert holds == {g: "conflict" if "conflict" in k else "review" for g, k in by_group.items() if k & {"conflict", "insufficient"}}


def test_a_hot_block_is_linear_where_facts_differ_or_are_copies(spark):
    """A block with a third of 60,000 rows, most of them copies or far apart: far fewer pairs than its square are judged."""
    rows = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000)).alias("b"), F.col("id").alias("g"), (F.when(F.col("id") % 2 == 0, 7).otherwise(100 * F.col("id") + 20)).alias("v"))
    got = verdicts.slot_collisions(rows, ["b"], "g", ["v"], judge)
    assert {r.code for r in got.where("b = 0").collect()} == {"schedule-conflict"}
    assert got.where("b = 0").first().n == 20_002


def test_of_nothing(spark):
    assert verdicts.held(spark.createDataFrame([], "b string, g int, v int"), ["b"], "g", ["v"], judge).collect() == []
