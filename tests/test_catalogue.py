import json

import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import civil, html, text, urls
from tessella.operators import agenda, classify, linkage, quality
from tessella.sources import catalog
from tessella.streaming import searches

from .compare import difference

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


#: Queries that have no rows on the smallest tables.
MAY_BE_EMPTY = {"identity_candidates", "identity_collapse", "circuit_breaker", "agenda_filter_all"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_agree_with_sql(spark, name):
    said = difference(spark, SF, name)
    assert said is None or (said == "no rows" and name in MAY_BE_EMPTY)


def test_text(spark):
    assert value(spark, text.fold(F.lit("  Ópera: «Niño» n.º 5 "))) == "opera nino n 5"
    assert value(spark, text.slug(F.lit("¡¡!!"))) == "evento"
    assert value(spark, text.has_span(F.lit("La Bohème, acto I"), F.lit("bohème"))) is True
    assert value(spark, text.has_span(F.lit("Bohemes"), F.lit("boheme"))) is False
    assert value(spark, text.contains(F.lit("x"), " ")) is True


def test_html(spark):
    assert value(spark, html.decode_entities(F.lit("a&#233;b&#xE9; &amp;lt; &foo; &#999999999;"))) == "aébé &lt; &foo; &#999999999;"
    assert value(spark, html.blocks(F.lit("<script>x<p></script><p>a<br>b <b>c</b></p><!-- z -->d"))) == ["a", "b c", "d"]


def test_urls(spark):
    assert value(spark, urls.normalize(F.lit(" HTTPS://A.Example/B//?x=1#f"))) == "https://a.example/B?x=1"
    assert value(spark, urls.strip_tracking(F.lit("http://a/b?utm_source=x&id=2&gclid=1"))) == "http://a/b?id=2"
    assert [value(spark, urls.kind(F.lit(u))) for u in ("http://a/", "http://a/agenda/12-gala", "http://a/eventos", "http://a/una-gala")] == ["listing", "event-detail", "listing", "event-detail"]


def test_civil(spark):
    at = lambda s: value(spark, F.date_format(civil.to_utc(F.lit(s).cast("timestamp")), "yyyy-MM-dd HH:mm"))
    assert at("2026-10-25 02:30") == "2026-10-25 01:30"  # the later of two
    assert at("2026-07-01 12:00") == "2026-07-01 10:00"
    day = F.lit("2026-09-01").cast("date")
    assert value(spark, civil.upcoming(day, "2026-09-01 10:00", F.lit("09:59"))) is False
    assert value(spark, civil.upcoming(day, "2026-09-01 10:00", F.lit(None).cast("string"))) is True
    assert value(spark, civil.day(F.lit("2026-02-30"))) is None


def test_first_page_keeps_ties(spark):
    rows = spark.createDataFrame([(d,) for d in "aabbbc"], "d string")
    assert sorted(r.d for r in agenda.first_page(rows, "d", 3).collect()) == list("aabbb")


def test_parents(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "x"), ("c", "d"), ("d", "e"), ("e", None)], "id string, parent string")
    assert {r.path: r.code for r in quality.parent_cycles(rows, "id", "parent").collect()} == {"a": "self-parent-venue", "b": "missing-parent-venue", "c": "nested-venue-parent"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", "x")], "k int, t string, f string")
    new = spark.createDataFrame([(1, "z", "y"), (3, "c", None)], "k int, t string, f string")
    got = {r.k: (r.t, r.f, r.change) for r in linkage.upsert(old, new, "k", {"t": "published", "f": "fill"}).collect()}
    assert got == {1: ("a", "y", "updated"), 2: ("b", "x", "untouched"), 3: ("c", None, "created")}


def test_longest_span(spark):
    docs = spark.createDataFrame([(1, "Johann Sebastian Bach y Bach")], "id long, text string")
    names = spark.createDataFrame([("bach", "short"), ("Johann Sebastian Bach", "long")], "alias string, name string")
    got = classify.longest(classify.spans(docs, "id", "text", names, "alias", "name"), "id").collect()
    assert sorted((r.name, r.start) for r in got) == [("long", 0), ("short", 4)]


def test_catalogue(spark, tmp_path):
    for name in catalog.SCHEMAS:
        (tmp_path / name).mkdir()
        (tmp_path / name / "x_1.json").write_text(json.dumps({"schemaVersion": 1, "id": "x_1"}))
    assert catalog.load(spark, str(tmp_path))["events"].count() == 1
    (tmp_path / "venues" / "x_2.json").write_text(json.dumps({"schemaVersion": 1, "id": "x_3", "odd": 1}))
    (tmp_path / "venues" / "x_4.json").write_text("{")
    found = {(r.path, r.code) for r in catalog.issues(catalog.read(spark, str(tmp_path), "venues")).collect()}
    assert found == {("x_2.json", "schema"), ("x_2.json", "filename-id-mismatch"), ("x_4.json", "invalid-json")}
    with pytest.raises(ValueError, match="x_2.json"):
        catalog.load(spark, str(tmp_path))


def test_streams(spark, tmp_path):
    rows = [("u", f"2026-01-01 00:00:0{s}", q) for s, q in ((0, "a"), (1, "ab"), (8, "c"))] + [("u", "2026-01-02 00:00:00", "late")]
    spark.createDataFrame(rows, "k string, ts string, q string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, q string").json(str(tmp_path / "in"))
    out = searches.settled_searches(stream, "k", "ts", "q", "5 seconds")
    out.writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(60)
    assert {(r.q, r.events) for r in spark.table("settled").collect()} >= {("ab", 2), ("c", 1)}
    seen = []
    searches.start_upserts(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sum(seen) == 4
