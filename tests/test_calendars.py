"""Calendar plans with times against a plan made one session after the other, and written cases."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest

from tessella.operators import calendars

TODAY = date(2027, 3, 10)
KEYS = "k int, ident string, date date, time string"


def one_by_one(published, proposed, changes, scope):
    """(ident, date, time, action) of one event, or None for review. Lists are in order."""
    left, todo, out = list(published), sorted(set(proposed), key=lambda s: (s[0], s[1] or "")), []
    inside = lambda d: scope is not None and scope[0] <= d <= scope[1]
    meets = lambda a, b: a[0] == b[0] and (a[1] is None or b[1] is None or a[1] == b[1])
    if any(meets(a, c) or b == d for i, (a, b) in enumerate(changes) for c, d in changes[i + 1 :]):
        return None
    taken = []
    for origin, to in changes:
        own = [p for p in left if p[1] == origin[0] and (origin[1] is None or p[2] == origin[1])]
        there = [p for p in left if (p[1], p[2]) == to and p not in own]
        wanted = todo.count(to)
        if origin[0] < TODAY:
            if not own and (len(there) != 1 and wanted != 1 or len(there) > 1):
                return None
        elif len(own) > 1 or len(there) > 1:
            return None
        elif not own:
            if not (len(there) == 1 or to[0] >= TODAY and wanted == 1):
                return None
        elif wanted != 1 or there:
            return None
        else:
            left.remove(own[0])
            taken.append(to)
            out.append((own[0][0], *to, "moved"))
    todo = [s for s in todo if s not in taken]
    for s in list(todo):
        same = sorted(p for p in left if (p[1], p[2]) == s)
        if same:
            left.remove(same[0])
            todo.remove(s)
            out.append((*same[0], "kept"))
    for s in list(todo):
        able = [p for p in left if p[1] == s[0] >= TODAY and (inside(s[0]) or p[2] is None)]
        others = [x for x in todo if x[0] == s[0]]
        if able and (len(able) != 1 or len(others) != 1):
            return None
        if able and (inside(s[0]) or s[1] is not None):
            left.remove(able[0])
            todo.remove(s)
            out.append((able[0][0], *s, "timed"))
    out += [(None, *s, "new") for s in todo]
    return out + [(*p, "dropped" if p[1] >= TODAY and inside(p[1]) else "kept") for p in left]


@pytest.mark.parametrize("seed", range(3))
def test_against_one_session_after_the_other(spark, seed):
    r = random.Random(seed)
    days = [TODAY + timedelta(days=i) for i in range(-2, 4)]
    times = [None, "18:00", "20:00"]
    p, n, c, s, want = [], [], [], [], Counter()
    places = {}
    for k in range(400):
        some = lambda most: [(r.choice(days), r.choice(times)) for _ in range(r.randrange(most))]
        published = [(f"{k}-{i}", *x) for i, x in enumerate(some(5))]
        proposed = some(5) + [x[1:] for x in published if r.random() < 0.4]
        changes = [(r.choice([x[1:] for x in published] or [(days[0], None)]) if r.random() < 0.8 else (r.choice(days), None), r.choice(proposed or [(days[3], "20:00")])) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        changes = list(dict.fromkeys(changes))
        scope = r.choice([None, None, (days[1], days[4])])
        p += [(k, *x) for x in published]
        n += [(k, *x) for x in proposed]
        c += [(k, i, *a, *b) for i, (a, b) in enumerate(changes)]
        s += [(k, *scope)] if scope else []
        out = one_by_one(published, proposed, changes, scope)
        if out is None:
            out = [(*x, "review") for x in published]
        for x in out:
            want[k, *x] += 1
        places[k] = (len(published), sorted(((x[1], x[2] or "") for x in out if x[3] == "new")))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(5)
    got = calendars.planned(frame(p, KEYS), frame(n, "k int, date date, time string"), frame(c, "k int, order int, from_date date, from_time string, to_date date, to_time string"), frame(s, "k int, first date, last date"), "k", "ident", str(TODAY)).collect()
    assert Counter((x.k, x.ident, x.date, x.time, x.action) for x in got) == want
    assert len({x[4] for x in want}) == 6
    for x in got:
        if x.action == "new":
            many, order = places[x.k]
            assert x.place == many + order.index((x.date, x.time or "")) + 1


def test_postponed_and_cancelled(spark):
    d = lambda n: date(2027, 4, n)
    published = spark.createDataFrame([(1, "a", d(1), "20:00"), (2, "b", d(1), None), (2, "c", d(2), None), (3, "d", d(1), None), (4, "e", d(1), "19:00")], KEYS)
    incoming = spark.createDataFrame([(1, d(9), None), (2, d(9), "18:00"), (3, d(1), "21:00"), (4, d(5), "19:00")], "k int, date date, time string")
    status = spark.createDataFrame([(1, "scheduled", "postponed"), (2, "postponed", "scheduled"), (3, "scheduled", "cancelled"), (4, "scheduled", "scheduled")], "k int, was string, now string")
    got = {(r.k, r.ident, r.date.day, r.time, r.change, r.status) for r in calendars.merged(published, incoming, status, "k", "ident").collect()}
    assert got == {(1, "a", 9, None, "moved", "scheduled"), (2, "b", 1, None, "kept", "scheduled"), (2, "c", 2, None, "kept", "scheduled"), (2, None, 9, "18:00", "new", "scheduled"), (3, "d", 1, "21:00", "refined", "cancelled"), (4, "e", 1, "19:00", "kept", "scheduled"), (4, None, 5, "19:00", "new", "scheduled")}
