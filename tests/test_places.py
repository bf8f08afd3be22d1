"""Numbers within keys and unique names against brute force, with hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators.places import numbered, unique_names


def test_numbers_within_hot_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v int").repartition(7)
    got = {x.id: x.place for x in numbered(df, ["k"], [F.desc("v"), F.col("id").asc()]).collect()}
    want, seen = {}, Counter()
    for k, i, v in sorted(rows, key=lambda x: (-x[2], x[1])):
        seen[k] += 1
        want[i] = seen[k]
    assert got == want
    every = {x.id: x.n for x in numbered(df, [], [F.col("id").desc()], "n").collect()}
    assert every == {i: 3000 - i for i in range(3000)}


@pytest.mark.parametrize("seed", range(4))
def test_unique_names(spark, seed):
    r = random.Random(seed)
    stems = ["x", "x-2", "x-3", "x-2-2", "y", "long" * 4, "long" * 4 + "z", "long" * 3 + "lon"]
    rows = [(i, r.choice(stems)) for i in range(120)]
    taken = {"x-2", "y", "y-7", ("long" * 4)[:12]}
    df = spark.createDataFrame(rows, "id int, name string")
    out = unique_names(df, F.col("name"), spark.createDataFrame([(t,) for t in taken], "slug string"), "slug", ["id"], most=12).collect()
    names = [x.slug for x in out]
    assert len(out) == 120 and len(set(names)) == 120 and not set(names) & taken and all(len(n) <= 12 for n in names)
    for x in out:
        assert x.slug == x.name[:12] or x.slug.rpartition("-")[2].isdigit()
    assert next(x.slug for x in out if x.id == 0) == rows[0][1][:12] or rows[0][1][:12] in taken


def test_many_taken_and_long_ones(spark):
    """A thousand taken numbers take no thousand rounds, nor do long roots that are cut to the same name."""
    taken = spark.createDataFrame([("x",), *((f"x-{i}",) for i in range(2, 1000))], "slug string")
    rows = [(i, "x") for i in range(50)] + [(100 + i, "w" * 112 + f"{i:08d}") for i in range(60) for _ in range(1)] + [(200 + i, "w" * 112 + f"{i:08d}") for i in range(60)]
    out = unique_names(spark.createDataFrame(rows, "id int, name string"), F.col("name"), taken, "slug", ["id"], rounds=3).collect()
    assert len({x.slug for x in out}) == 170 and {x.slug for x in out if x.id < 50} == {f"x-{i}" for i in range(1000, 1050)} and max(len(x.slug) for x in out) == 120


def test_three_that_meet(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2")], "id int, name string")
    none = spark.createDataFrame([], "slug string")
    assert {x.id: x.slug for x in unique_names(df, F.col("name"), none, "slug", ["id"]).collect()} == {1: "x", 2: "x-3", 3: "x-2"}
    assert unique_names(df.limit(0), F.col("name"), none, "slug", ["id"]).collect() == []
