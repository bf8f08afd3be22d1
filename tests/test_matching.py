"""Identity from tables to an action, on written cases: wildcard times, aliases with dates, owners of dates, stale identifiers, shared addresses, slots."""

from datetime import date

import pytest

from tessella.operators import matching

D = lambda n: date(2027, 5, n)
NONE: list = []


def frames(spark, observed, sessions, published, published_sessions, cited, aliases=()):
    facts = "place string, status string, title string, performers array<string>, works array<struct<title:string,composer:string>>, composers array<string>"
    frame = spark.createDataFrame
    return {
        "observed": frame(observed, f"id int, source string, external string, url string, {facts}"), "sessions": frame(sessions, "id int, date date, time string"), "published": frame(published, f"event string, {facts}"),
        "published_sessions": frame(published_sessions, "event string, date date, time string"), "cited": frame(cited, "event string, source string, external string, url string"),
        "aliases": frame(list(aliases), "event string, source string, external string, url string, date date"), "places": frame([("hall", None), ("room", "hall"), ("other", None)], "place string, parent string"),
    }


def seen(i, external=None, url=None, place="hall", status="scheduled", title="noche de verano", performers=NONE, works=NONE, source="s"):
    return (i, source, external, url, place, status, title, performers, works, NONE)


def event(e, place="hall", status="scheduled", title="noche de verano", performers=NONE, works=NONE):
    return (e, place, status, title, performers, works, NONE)


def decided(spark, **kw):
    recyclable = kw.pop("recyclable", ())
    return {r.id: (r.action, r.method, r.event, r.n) for r in matching.matched(**frames(spark, **kw), recyclable=recyclable).collect()}


def test_methods_and_wildcards(spark):
    got = decided(
        spark,
        observed=[seen(1, "x1"), seen(2, None, "https://www.a.es/evento/misa-7/"), seen(3), seen(4, title="otra cosa"), seen(5, "old", title="otra cosa", place="other"), seen(6, "nobody", "https://www.a.es/agenda", title="nada", place="other"), seen(7, place="other")],
        sessions=[(1, D(1), None), (2, D(2), "20:00"), (3, D(3), None), (4, D(4), "20:00"), (5, D(5), "20:00"), (6, D(6), None), (7, D(3), "20:00")],
        published=[event("e1"), event("e2"), event("e3"), event("e4"), event("e5", place="other")],
        published_sessions=[("e1", D(1), "19:00"), ("e2", D(2), None), ("e3", D(3), "21:00"), ("e4", D(4), "20:00"), ("e5", D(5), "20:00")],
        cited=[("e1", "s", "x1", None), ("e2", "t", None, "https://WWW.a.es/evento/misa-7#top"), ("e3", "t", None, "https://www.a.es/agenda")],
        aliases=[("e5", "s", "old", None, D(5)), ("e4", "s", "old", None, D(9))],
    )
    assert got == {1: ("matched", "external-id", "e1", 1), 2: ("matched", "url", "e2", 1), 3: ("matched", "strong", "e3", 1), 4: ("ambiguous", "slot", "e4", 1), 5: ("matched", "alias", "e5", 1), 6: ("unmatched", None, None, None), 7: ("unmatched", None, None, None)}


def test_an_owner_of_the_date_goes_first_and_doubt_is_told(spark):
    got = decided(
        spark,
        observed=[seen(1, "x"), seen(2, "y"), seen(3, "z", place="other", title="tercera velada")],
        sessions=[(1, D(1), "20:00"), (2, D(9), "20:00"), (3, D(3), "20:00")],
        published=[event("e1"), event("e2"), event("e3", title="algo distinto"), event("e4", title="tercera velada")],
        published_sessions=[("e1", D(1), "20:00"), ("e2", D(2), "20:00"), ("e3", D(4), None), ("e4", D(3), "20:00")],
        cited=[("e1", "s", "x", None), ("e2", "s", "x", None), ("e3", "s", "y", None), ("e4", "s", "z", None)],
    )
    assert got == {1: ("matched", "external-id", "e1", 1), 2: ("ambiguous", "external-id", "e3", 1), 3: ("ambiguous", "external-id", "e4", 1)}


def test_shared_addresses_split_or_overlap(spark):
    url = "https://a.es/evento/ciclo-9"
    kw = dict(observed=[seen(1, None, url)], published=[event("e1"), event("e2")], cited=[("e1", "s", None, url), ("e2", "s", None, url)])
    apart = decided(spark, sessions=[(1, D(1), "20:00"), (1, D(2), "20:00")], published_sessions=[("e1", D(1), "20:00"), ("e2", D(2), "20:00")], **kw)
    # what is a strong match too is no reason for doubt: the address ranks first
    assert apart == {1: ("matched-many", "url", "e1", 2)}
    meet = decided(spark, sessions=[(1, D(1), None)], published_sessions=[("e1", D(1), "20:00"), ("e2", D(1), "18:00")], **kw)
    assert meet == {1: ("ambiguous", "url", "e1", 2)}


@pytest.mark.parametrize(("mine", "theirs", "want"), [(["ana ruiz"], ["ana ruiz"], "matched"), (["ana ruiz"], ["luis gil"], "ambiguous"), ([], [], "ambiguous")])
def test_slots_by_music(spark, mine, theirs, want):
    got = decided(
        spark, observed=[seen(1, title="a b c", performers=mine)], sessions=[(1, D(1), "20:00"), (1, D(2), None)], published=[event("e1", title="x y z", performers=theirs), event("e2", title="x y z", performers=theirs, status="cancelled")],
        published_sessions=[("e1", D(1), "20:00"), ("e2", D(1), "20:00"), ("e1", D(2), "19:00")], cited=[],
    )
    assert got == {1: (want, "slot", "e1", 1)}


def test_of_nothing(spark):
    assert decided(spark, observed=[], sessions=[], published=[], published_sessions=[], cited=[]) == {}


def test_only_what_a_source_says_is_judged(spark):
    """A strong match is compatible by itself, so it asks for no dates; an identifier is judged."""
    f = frames(
        spark, observed=[seen(1), seen(2, "x")], sessions=[(1, D(1), "20:00"), (2, D(2), "20:00")], published=[event("e1"), event("e2", title="otra")],
        published_sessions=[("e1", D(1), "20:00"), ("e2", D(2), "20:00")], cited=[("e2", "s", "x", None)],
    )
    hits = matching.candidates(*(f[c] for c in ("observed", "sessions", "published", "published_sessions", "cited", "aliases")))
    dates = matching.dates_of(hits.where("method != 'strong'").select("id", "event"), f["sessions"], f["published_sessions"])
    got = {(r.id, r.event, r.method, r.guarded, r.verdict) for r in matching.judged(hits, f["observed"], f["published"], dates, f["places"]).collect()}
    assert got == {(1, "e1", "strong", False, "compatible"), (2, "e2", "external-id", True, "compatible")}
