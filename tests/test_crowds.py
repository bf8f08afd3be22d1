"""Strong matches and slots counted where both sides meet: against pairs one by one, in hot places and days, with copies and repeated sessions, and what that stores."""

import random
from datetime import date

import pytest

from tessella.operators import matching

from .test_deals import stored
from .test_matching import D, decided, event, frames, seen

NAMES = ["ana ruiz", "luis gil", "a ruiz"]


def some(seed, n=80):
    """Observations 0 to n and events from 1000 with sessions on few days, some twice, some without a time, date or place."""
    r = random.Random(seed)
    sides, sessions = ([], []), ([], [])
    for side, first in ((0, 0), (1, 1000)):
        for i in range(first, first + n):
            title, place, performers = r.choice(["noche", "noche", "dia", ""]), r.choice(["hall", "hall", "room", None]), r.sample(NAMES, r.randrange(2))
            sides[side].append((i, place, r.choice(["scheduled", "scheduled", "cancelled"]), title, performers))
            sessions[side].extend((i, r.choice([D(1), D(2), D(3), None]), r.choice(["20:00", "18:00", None])) for _ in range(r.randrange(5)))
    return sides, sessions


def tables(spark, seed):
    (observed, published), (mine, theirs) = some(seed)
    f = frames(
        spark, [seen(i, place=p, status=s, title=t, performers=x) for i, p, s, t, x in observed], mine, [event(str(i), place=p, status=s, title=t, performers=x) for i, p, s, t, x in published],
        [(str(i), d, t) for i, d, t in theirs], [],
    )
    o, p = matching.with_sessions(f["observed"], f["sessions"], "id"), matching.with_sessions(f["published"], f["published_sessions"], "event")
    return observed, published, mine, theirs, o, p


def conflict(a, b):
    """Performers on both sides, and none of one name; A. Ruiz may be Ana Ruiz."""
    alike = lambda x, y: x == y or {x, y} == {"ana ruiz", "a ruiz"}
    return bool(a and b and not any(alike(x, y) for x in a for y in b))


@pytest.mark.parametrize(("seed", "cell"), [(1, 4), (2, 2_000)])
def test_counts_are_those_of_pairs(spark, seed, cell):
    observed, published, mine, theirs, o, p = tables(spark, seed)
    meet = lambda i, e, vague: any(x[0] == i and y[0] == e and x[1] and x[1] == y[1] and (x[2] == y[2] if not vague else None in (x[2], y[2]) or x[2] == y[2]) and (vague or x[2]) for x in mine for y in theirs)
    want = {(a[0], str(b[0])) for a in observed for b in published if a[1] and a[1] == b[1] and a[3] and a[3] == b[3] and not conflict(a[4], b[4]) and meet(a[0], b[0], True)}
    each = matching.strong(o, p, each=True, cell_rows=cell).collect()
    assert len(each) == len(want) > 50 and {(r.id, r.event) for r in each} == want
    by_id = {i: sorted(e for j, e in want if j == i) for i, _ in want}
    got = {r.id: (r.n, r.first, r.last) for r in matching.strong(o, p, cell_rows=cell).collect()}
    assert got == {i: (len(e), e[0], e[-1]) for i, e in by_id.items()}
    titled = lambda a, b: a[3] == b[3] and len(a[3]) >= 4
    kind = lambda a, b: "match" if titled(a, b) else "conflict" if conflict(a[4], b[4]) else "match" if a[4] and b[4] else "insufficient"
    music = {(a[0], str(b[0])): kind(a, b) for a in observed for b in published if a[1] and a[1] == b[1] and b[2] != "cancelled" and meet(a[0], b[0], False)}
    found = {r.id: (r.action, r.event, r.n) for r in matching.by_slot(o, p, cell_rows=cell).collect()}
    told = {}
    for i in {i for i, _ in music}:
        of = {k: sorted(e for (j, e), m in music.items() if j == i and m == k) for k in ("match", "conflict", "insufficient")}
        n = len(of["match"]) + len(of["conflict"])
        told[i] = ("matched" if len(of["match"]) == 1 and not of["conflict"] else "ambiguous", (of["match"] or of["conflict"] or of["insufficient"])[0], n or len(of["insufficient"]))
    assert found == told and len({a for a, _, _ in told.values()}) == 2


def test_strong_matches_beside_what_a_source_says(spark):
    """An event that is found by an identifier and strongly is one; the others are told as a number."""
    kw = dict(
        observed=[seen(1, "x"), seen(2, "y"), seen(3, "z")], sessions=[(i, D(i), "20:00") for i in (1, 2, 3)], published=[event("e1"), event("e2"), event("e3"), event("e4"), event("e5", title="otra cosa")],
        published_sessions=[("e1", D(1), "20:00"), ("e2", D(1), None), ("e3", D(2), "20:00"), ("e4", D(3), "20:00"), ("e5", D(9), "20:00")],
        cited=[("e2", "s", "x", None), ("e3", "s", "y", None)], aliases=[("e5", "s", "z", None, None)],
    )
    assert decided(spark, **kw) == {1: ("ambiguous", "external-id", "e2", 2), 2: ("matched", "external-id", "e3", 1), 3: ("ambiguous", "alias", "e5", 2)}
    # a source that gives one identifier to event after event: all that it is found by is judged strictly, as pairs
    assert decided(spark, recyclable=["s"], **kw) == {1: ("ambiguous", "external-id", "e2", 2), 2: ("matched", "external-id", "e3", 1), 3: ("matched", "strong", "e4", 1)}


def test_a_hot_day_stores_no_pairs(spark):
    n = 300
    f = frames(spark, [seen(i) for i in range(n)], [(i, D(1), "20:00") for i in range(n)], [event(f"e{i}") for i in range(n)], [(f"e{i}", D(1), None) for i in range(n)], [])
    before = stored(spark)
    got = matching.matched(**f).collect()
    assert {(r.action, r.method, r.event, r.n, r.reason) for r in got} == {("ambiguous", "strong", "e0", n, "several plausible events")} and len(got) == n
    assert stored(spark) - before < 500_000


def test_dates_without_a_year_of_their_own(spark):
    """Years of fewer digits sort and meet by day too."""
    f = frames(spark, [seen(1)], [(1, date(987, 5, 1), "20:00")], [event("e1")], [("e1", date(987, 5, 1), None)], [])
    assert [(r.id, r.action, r.event) for r in matching.matched(**f).collect()] == [(1, "matched", "e1")]
