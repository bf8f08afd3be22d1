"""References, merged lists, citations, composers and the health of runs on written cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import composers, merging, resolve, run_health


def test_references(spark):
    events = spark.createDataFrame([(1, "v1", ["o2", "o1", "o2"], None), (2, "v1", [], "s1"), (3, None, None, None)], "id int, v string, os array<string>, s string")
    venues, orgs = spark.createDataFrame([("v1", "Sala")], "k string, name string"), spark.createDataFrame([("o1", "A"), ("o2", "B")], "k string, name string")
    got = {r.id: (r.venue and r.venue.name, [x.name for x in r.told]) for r in resolve.many(resolve.one(events, "id", "v", venues, "k", "venue"), "id", "os", orgs, "k", "told").collect()}
    assert got == {1: ("Sala", ["B", "A", "B"]), 2: ("Sala", []), 3: (None, [])}
    with pytest.raises(Exception, match="event 2 refers to a series that isn't there: s1"):
        resolve.one(events, "id", "s", venues, "k", "series").collect()
    with pytest.raises(Exception, match="isn't there: o2"):
        resolve.many(events, "id", "os", orgs.where("k = 'o1'"), "k", "told").collect()
    assert [r.series for r in resolve.one(events, "id", "s", venues, "k", "series", strict=False).collect()] == [None] * 3
    cited = spark.createDataFrame([(1, "v1"), (1, "o1")], "id int, source string")
    first = spark.createDataFrame([(1, "o1")], "id int, prim string")
    both = venues.union(orgs)
    assert {(r.source, r.is_primary) for r in resolve.citations(cited, "id", "source", first, "prim", both, "k").collect()} == {("v1", False), ("o1", True)}


def plain(old, new):
    """(value, differs) of lists of (key, note)."""
    if not new or not old:
        return old or new, False
    used, value = set(), []
    for key, note in old:
        mate = next((i for i, (k, _) in enumerate(new) if k == key and i not in used), None) if key else None
        if mate is not None:
            used.add(mate)
        value.append((key, note or (new[mate][1] if mate is not None else None)))
    whole = all(not k or k in [n[0] for n in new] for k, _ in old)
    if whole:
        for i, (key, note) in enumerate(new):
            if i not in used and key and key not in [v[0] for v in value]:
                value.append((key, note))
    return value, not (value == new or whole and len(value) > len(old))


@pytest.mark.parametrize("seed", range(3))
def test_lists(spark, seed):
    r = random.Random(seed)
    some = lambda: [(r.choice(["", "a", "b", "c"]), r.choice([None, "x", "y"])) for _ in range(r.randrange(5))]
    rows = [(i, some(), some()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, old array<struct<key:string,note:string>>, new array<struct<key:string,note:string>>")
    out = df.select("i", merging.lists(F.col("old"), F.col("new"), lambda x: x["key"], lambda a, b: a.withField("note", F.coalesce(a["note"], b["note"]))).alias("m")).collect()
    for x in out:
        assert ([tuple(v) for v in x.m.value], x.m.differs) == plain(*rows[x.i][1:]), rows[x.i]


def test_citations(spark):
    schema = "k int, s string, u string, c string, e string"
    old = spark.createDataFrame([(1, "a", "https://X.es/p/", "2024-01-01", "7"), (1, "b", "https://x.es/p", "2024-01-01", None)], schema)
    new = spark.createDataFrame([(1, "a", "https://x.es/p#top", "2024-02-01", None), (1, "a", "https://x.es/q", "2024-02-01", None), (1, "b", "https://x.es/p", None, "9")], schema)
    got = {tuple(r) for r in merging.citations(old, new, "k", "s", "u", "c", "e").collect()}
    assert got == {(1, "a", "https://X.es/p/", "2024-02-01", "7"), (1, "a", "https://x.es/q", "2024-02-01", None), (1, "b", "https://x.es/p", "2024-01-01", "9")}


def test_composers(spark):
    names = spark.createDataFrame([("Ludwig van Beethoven", "Ludwig van Beethoven"), ("Beethoven", "Ludwig van Beethoven"), ("J. S. Bach", "Johann Sebastian Bach"), ("Bach", "Johann Sebastian Bach"), ("C. P. E. Bach", "Carl Philipp Emanuel Bach"), ("Dvořák", "Antonín Dvořák")], "alias string, name string")
    said = ["BEETHOVEN", "Beethoven (1770-1827)", "Música de Ludwig van Beethoven", "Beethoven, Ludwig van", "J.S. Bach", "JS Bach", "Bach", "atribuida a Dvorak", "Nadie Conocido", "", None]
    rows = spark.createDataFrame([(i, 1, s) for i, s in enumerate(said)], "i int, event int, said string")
    out = composers.identified(rows, ["i"], "said", names, "alias", "name")
    got = {r.i: (r.composer, r.stage) for r in out.collect()}
    lvb, jsb = "Ludwig van Beethoven", "Johann Sebastian Bach"
    assert got == {0: (lvb, "alias"), 1: (lvb, "years"), 2: (lvb, "alias"), 3: (lvb, "inverted"), 4: (jsb, "alias"), 5: (jsb, "compact"), 6: (None, None), 7: ("Antonín Dvořák", "attribution"), 8: (None, None), 9: (None, None), 10: (None, None)}
    assert {(r.path, r.message) for r in composers.repeated(out, "event", "i", "said").collect()} == {("1", f"{lvb}: {' | '.join(said[:4])}"), ("1", f"{jsb}: {' | '.join(said[4:6])}")}


def test_health(spark):
    runs = spark.createDataFrame([(1, True, [], 0), (2, True, [], 2), (3, False, ["boom"], 0), (4, True, None, None)], "run int, batch_ok boolean, fatal array<string>, possibly_missing int")
    sources = spark.createDataFrame([(1, "a", True, True, False, "complete"), (2, "a", True, True, True, "partial"), (2, "b", False, False, False, None), (3, "a", False, True, False, None)], "run int, s string, usable boolean, extracted boolean, hydration_severe boolean, coverage string")
    found = run_health.findings(runs, sources, "run", "s")
    assert {r.reason for r in found.where("run = 2").collect()} == {"possibly-missing", "source-coverage-partial:a", "source-hydration-incomplete:a", "source-failed:b"}
    got = {r.run: (r.health, r.auto_merge, r.findings) for r in run_health.evaluated(runs, found, "run").collect()}
    assert got == {1: ("clean", True, 0), 2: ("review", False, 4), 3: ("fatal", False, 3), 4: ("fatal", False, 1)}
