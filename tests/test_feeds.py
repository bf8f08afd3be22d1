"""Feed readers, notices, names, calendars and loops on small hand-made rows."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessella.functions import idents, notices, text, urls
from tessella.operators import classify, export, identity, quality, reconcile
from tessella.sources import feeds


def pages(spark, *bodies):
    return spark.createDataFrame([(f"https://s.example/{i}", b) for i, b in enumerate(bodies)], "url string, body string")


def test_every_kind_of_feed(spark):
    item = {"id": "7", "title": "Trío", "start": "2027-04-11", "venue": "Sala", "status": "scheduled", "url": "https://s.example/7"}
    got = feeds.listing(pages(spark, json.dumps({"total": 3, "items": [item, item | {"title": " "}, item | {"start": None}]}), "no json", None), "json-feed").collect()
    assert [(r.title, r.discard) for r in got] == [("Trío", None), (" ", "missing-title"), ("Trío", "missing-date")]
    wp = feeds.listing(pages(spark, json.dumps([{"id": 1, "link": "https://s.example/a", "date": "2027-01-02T10:00:00", "title": {"rendered": "<b>A</b> &amp; B"}}])), "wp-rest").first()
    assert (wp.title, wp.external_id, wp.discard) == ("A & B", "1", None)
    tribe = feeds.listing(pages(spark, json.dumps({"total": 1, "events": [{"id": 5, "url": "u", "title": "T", "start_date": "2027-01-02 19:00:00", "venue": {"venue": "V"}}]})), "tribe").first()
    assert (tribe.venue, tribe.start) == ("V", "2027-01-02 19:00:00")
    event = {"@type": "MusicEvent", "name": "N", "startDate": "2027-01-02T19:00:00+01:00", "eventStatus": "https://schema.org/EventCancelled", "location": {"name": "L"}}
    script = lambda x: f'<html><script type="application/ld+json">{json.dumps(x)}</script></html>'
    ld = feeds.listing(pages(spark, script(event), script([event, {"@type": "Person", "name": "x"}]), script({"@graph": [event]}), "<p>none</p>"), "json-ld").collect()
    assert [(r.title, r.status, r.venue) for r in ld] == [("N", "cancelled", "L")] * 3
    site = feeds.listing(pages(spark, "<urlset><url><loc>https://s.example/x?a=1&amp;b=2</loc><lastmod>2027-01-01</lastmod></url><url><loc>y</loc></url></urlset>"), "sitemap").collect()
    assert [(r.detail_url, r.start) for r in site] == [("https://s.example/x?a=1&b=2", "2027-01-01"), ("y", None)]
    card = feeds.listing(pages(spark, '<a class="c" href="/e/1"><h3>Uno</h3><time datetime="2027-03-04">4</time></a><a href="/e/1">más</a><a href="/e/2"></a>'), "cards").collect()
    assert {(r.detail_url, r.start, r.discard) for r in card} == {("/e/1", "2027-03-04", None), ("/e/2", None, "missing-title")}
    with pytest.raises(ValueError):
        feeds.parser("cards")(feeds.cards)


def test_coverage_and_selection(spark):
    two = pages(spark, json.dumps({"total": 3, "items": [1, 2]}), json.dumps({"total": 3, "items": [3]}))
    assert feeds.coverage(two).first() == (3, 3, True) and not feeds.coverage(two.limit(1)).first().complete
    sources = spark.createDataFrame([("a", True), ("b", False)], "id string, enabled boolean")
    assert [r.id for r in feeds.selected(sources).collect()] == ["a"] and [r.id for r in feeds.selected(sources, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        feeds.selected(sources, ["z"])


def one(spark, value, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} {'array<string>' if isinstance(a, list) else 'string'}" for i, a in enumerate(args)))
    return row.select(value(*(F.col(c) for c in row.columns)).alias("v")).first().v


def test_dates_in_prose(spark):
    assert one(spark, notices.spanish_date, "el Sábado, 11 de ABRIL de 2027") == date(2027, 4, 11)
    assert one(spark, notices.spanish_date, "31 de febrero de 2027") is None and one(spark, notices.spanish_date, "11 de abril") is None
    assert one(spark, lambda t: notices.spanish_date(t, F.lit(2027)), "1 setiembre") == date(2027, 9, 1)
    assert one(spark, notices.clock, "a las 9.05 h") == "09:05" and one(spark, notices.clock, "25:10") is None
    n = one(spark, notices.notice, "Concierto aplazado al 3 de mayo de 2027")
    assert (n.status, n.date) == ("postponed", date(2027, 5, 3)) and one(spark, notices.notice, "Se cancela la función").status == "cancelled"
    assert tuple(one(spark, notices.observed, "2026-07-01T22:30:00Z")) == (date(2026, 7, 2), "00:30")
    assert tuple(one(spark, notices.observed, "2026-07-01")) == (date(2026, 7, 1), None) and tuple(one(spark, notices.observed, "soon")) == (None, None)
    assert one(spark, lambda t: notices.long_date(t.cast("date")), "2027-04-11") == "domingo, 11 de abril de 2027"


@pytest.mark.parametrize(
    ("a", "b", "agree"),
    [("ana torres", "ana torres", True), ("a torres", "ana torres", True), ("anatorres", "ana torres", True), ("ana torres", "luis torres", False), ("torres", "ana torres", False),
     ("orquesta nacional", "orquesta nacional de espana", True), ("", "ana", False), ("ana ruiz", "ana rios", False)],
)
def test_names(spark, a, b, agree):
    assert one(spark, identity.names_agree, a, b) is agree and one(spark, identity.names_agree, b, a) is agree


def test_works_and_titles(spark):
    work = lambda t, c: F.struct(t.alias("title"), c.alias("composer"))
    agree = lambda *x: one(spark, lambda t, c, u, d: identity.works_agree(work(t, c), work(u, d)), *x)
    assert agree("misa en si bwv 232", "johann bach", "gran misa bwv232", "j bach") and not agree("sonata op 5", "a x", "sonata op 6", "a x")
    assert not agree("sinfonia", "", "sinfonia", "") and agree("sinfonia", "gustav mahler", "sinfonia", "g mahler") and not agree("la noche", "gustav mahler", "la noche", "clara wieck")
    assert one(spark, identity.titles_agree, "Concierto de La Noche", "la noche") and not one(spark, identity.titles_agree, "Concierto", "Recital")


def test_identifiers_and_titles(spark):
    assert one(spark, idents.quiet, "LA FLAUTA MÁGICA DE RTVE II.") == "La Flauta Mágica De RTVE II" and one(spark, idents.quiet, "Etc...") == "Etc..."
    assert one(spark, idents.event_id, "¡Año Nuevo!") == "evt_ano_nuevo"
    assert one(spark, lambda e: idents.occurrence_id(e, F.lit(3)), "evt_x") == "occ_x_03"
    assert one(spark, lambda a: urls.equivalent(a, F.lit("https://X.example/b?id=4"), "id"), "https://x.example/a?z=1&id=4")
    line = one(spark, export.folded, "ñ" * 80)
    assert all(len(x.encode()) <= 75 for x in line.split("\r\n")) and line.replace("\r\n ", "") == "ñ" * 80


def test_classification_order(spark):
    def said(t, substantial=False):
        return tuple(one(spark, lambda c: classify.eligible(c, F.lit(False), F.lit(substantial)), t))

    assert said("Taller de ópera") == ("exclude", "non-performance-activity") and said("jazz y ópera") == ("uncertain", "classical-and-nonclassical-coprincipal")
    assert said("jazz y ópera", True) == ("include", "mixed-program-classical-block") and said("pop y ópera") == ("exclude", "popular-music-identity")
    assert said("una tarde") == ("uncertain", "insufficient-evidence") and said("Gran ópera") == ("include", "opera-event")
    assert one(spark, lambda t: classify.kind(F.lit(None), t), "Sala X").rule_id == "alternative-space"


def test_calendar_moves(spark):
    d = lambda x: date(2027, *x)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    published = table([(1, "a", d((3, 1))), (1, "b", d((3, 5))), (2, "c", d((3, 1))), (3, "e", d((3, 1)))], "k int, ident string, day date")
    proposed = table([(1, d((3, 2))), (1, d((3, 9))), (2, d((3, 4)))], "k int, day date")
    changes = table([(1, d((3, 1)), d((3, 2))), (2, d((3, 1)), d((3, 4))), (2, d((3, 1)), d((3, 6)))], "k int, from date, to date")
    scopes = table([(1, d((3, 1)), d((3, 31)))], "k int, first date, last date")
    got = {(r.k, r.ident, r.day, r.action) for r in reconcile.calendar_plan(published, proposed, changes, scopes, "k", "ident", "day", "2027-01-01").collect()}
    assert got == {(1, "a", d((3, 2)), "moved"), (1, "b", d((3, 5)), "dropped"), (1, None, d((3, 9)), "new"), (2, "c", d((3, 1)), "review"), (3, "e", d((3, 1)), "kept")}


def test_parent_loops(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None), (7, 7)], "id int, parent int")
    assert sorted(r.path for r in quality.parent_loops(rows, "id", "parent").collect()) == ["1", "2", "3", "7"]
    assert quality.parent_loops(rows.limit(0), "id", "parent").count() == 0


def test_idents_are_free(spark):
    fresh = spark.createDataFrame([(1, "Misa"), (2, "Misa"), (3, "Trío")], "k int, title string")
    taken = spark.createDataFrame([("misa",), ("misa-7",)], "slug string")
    got = reconcile.with_idents(fresh, text.slug("title"), taken, "slug", ["k"])
    assert {(r.k, r.slug) for r in got.collect()} == {(1, "misa-8"), (2, "misa-9"), (3, "trio")}
