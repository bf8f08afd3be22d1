"""Places, structural differences, coverage and programmes on written cases."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessella.operators import changes, coverage, filters, programme, venues


def test_the_ladder_of_lookups(spark):
    frame = spark.createDataFrame
    catalogue = frame([("p1", "Teatro Real", "Madrid"), ("p2", "Sala Roja", "Madrid"), ("p3", "Sala Roja", "Getafe"), ("p4", "Auditorio", "Alcalá")], "place string, name string, municipality string")
    entries = venues.dictionary(
        catalogue, frame([("s1", "77", "p4"), ("s1", "78", "p1"), ("s1", "78", "p2")], "source string, facility string, place string"), frame([("s1", "sala", "p2"), (None, "x", "p1")], "source string, name string, place string"),
        frame([("El Real", "p1"), ("Ateneo", "k9"), ("", "p1"), (None, "p1")], "name string, place string"),
    )
    rows = [
        (1, "s1", "77", "Teatro Real", None, None, None, None), (2, "s1", "78", "TEATRO  REAL (Madrid)", None, None, None, None), (3, "s1", None, "Sala", None, None, None, None), (4, "s2", None, "Sala", None, None, None, None),
        (5, "s2", None, "Sala Roja", None, None, None, None), (6, "s2", None, "Sala Roja", "sala roja", "GETAFE", "nearby", None), (7, "s2", None, "el real, planta 2", None, None, None, None), (8, "s2", None, "Ateneo - salón", None, None, None, None),
        (9, None, None, None, "Ermita", "Pinto", "nearby", "Calle 1"), (10, None, None, "", "Ermita", "Pinto", "nearby", "Calle 2"), (11, None, None, "Ermita", "Ermita", "Pinto", "nearby", " "), (12, None, None, None, None, None, None, None),
    ]
    df = frame(rows, "id int, source string, facility string, text string, name string, municipality string, area string, address string")
    found = venues.resolved(df, "id", entries)
    got = {r.id: (r.target, r.method, r.state) for r in found.collect()}
    new = ("ven_ermita_pinto", "created", "new")
    assert got == {
        1: ("p4", "facility", "catalogue"), 2: ("p1", "name", "catalogue"), 3: ("p2", "source-name", "catalogue"), 4: (None, None, None), 5: (None, None, None), 6: ("p3", "proposed", "catalogue"), 7: ("p1", "alias", "catalogue"), 8: ("k9", "alias", "known"),
        9: new, 10: new, 11: (None, None, None), 12: (None, None, None),
    }
    assert [tuple(r) for r in venues.created(df, "id", found).collect()] == [("ven_ermita_pinto", "Ermita", "Pinto", "nearby", "Calle 1", 2)]


def walk(a, b, path):
    if a is None and b is None:
        return []
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in a for d in walk(a[k], b[k], f"{path}.{k}" if path else k)]
    if isinstance(a, list) and isinstance(b, list):
        get = lambda x, i: x[i] if i < len(x) else None
        return [d for i in range(max(len(a), len(b))) for d in walk(get(a, i), get(b, i), f"{path}[{i}]")]
    return [] if a == b else [path]


@pytest.mark.parametrize("seed", range(2))
def test_differences_at_any_depth(spark, seed):
    r = random.Random(seed)
    some = lambda f: None if r.random() < 0.25 else f()
    leaf = lambda: some(lambda: r.randrange(3))
    item = lambda: some(lambda: {"v": leaf(), "w": some(lambda: [leaf() for _ in range(r.randrange(3))])})
    row = lambda k: {"k": k, "a": leaf(), "s": some(lambda: {"x": leaf(), "y": some(lambda: {"z": leaf()})}), "l": some(lambda: [item() for _ in range(r.randrange(4))])}
    schema = "k int, a int, s struct<x:int,y:struct<z:int>>, l array<struct<v:int,w:array<int>>>"
    one, two = [row(k) for k in range(120)], [row(k) for k in range(120)]
    got = changes.differences(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), "k").collect()
    want = sorted((a["k"], p) for a, b in zip(one, two, strict=True) for p in walk({k: v for k, v in a.items() if k != "k"}, {k: v for k, v in b.items() if k != "k"}, ""))
    assert sorted((x.k, x.path) for x in got) == want and want


def test_differences_of_maps_columns_and_missing_rows(spark):
    one = spark.createDataFrame([(1, {"a": 1, "b": 2}, "x"), (2, None, "y"), (None, None, "z")], "k int, m map<string,int>, gone string")
    two = spark.createDataFrame([(1, {"b": 3, "c": None}, 5), (3, None, 6)], "k int, m map<string,int>, more int")
    got = {(r.k, r.path, r.before, r.after) for r in changes.differences(one, two, "k").collect()}
    assert got == {(1, "m{a}", "1", None), (1, "m{b}", "2", "3"), (1, "gone", "x", None), (1, "more", None, "5"), (2, "", '{"gone":"y"}', None), (3, "", None, '{"more":6}')}


def test_partial_listings(spark):
    d = lambda n: date(2027, 1, n)
    pages = spark.createDataFrame([("a", 2, True, d(1), d(5)), ("a", 2, True, d(6), d(9)), ("b", 2, True, d(1), d(5)), ("b", 2, False, d(6), d(9)), ("c", 1, False, None, None)], "s string, n int, ok boolean, a date, b date")
    cover = coverage.covered(pages, "s", "n", "ok", "a", "b")
    assert {(r.s, r.whole, r.reason) for r in cover.collect()} == {("a", True, None), ("b", False, "incomplete-listing"), ("c", False, "failed")}
    published = spark.createDataFrame([(1, "a", d(3)), (2, "a", d(4)), (3, "a", d(20)), (4, "b", d(4)), (5, "c", d(4)), (6, "z", d(4)), (7, "a", d(2))], "k int, s string, day date")
    got = {(r.k, r.state) for r in coverage.unseen(published, published.where("k = 1"), cover, "k", "s", "day", "2027-01-03").collect()}
    assert got == {(2, "possibly-missing"), (3, "withheld"), (4, "withheld"), (5, "withheld"), (6, "withheld")}
    assert {(r.k, r.partial) for r in coverage.kept(published, cover, "s", ["k"]).collect()} == {(1, False), (2, False), (3, False), (7, False), (4, True), (5, True), (6, True)}


def test_programmes(spark):
    page = ["AVISO: concierto aplazado", "Ana Ruiz, piano", "Luis Gil (violín)", "Orquesta Sinfónica", "Ludwig van Beethoven (1770-1827)", "Sonata n.º 5, op. 24", "Huelga convocada", "Otra línea", "Entradas:", "10 euros", "Programa", "J. S. Bach (1685-1750)", "Suite BWV 1068", "Elenco", "Eva Sol, soprano", "Coro de Cámara"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(page)] + [(2, 0, "Sinfonía en Re"), (3, 0, None)], "page int, place int, line string")
    told = programme.segmented(lines, "page", "place", "line")
    sections = {(r.page, r.place): r.section for r in told.collect()}
    assert [sections[1, i] for i in range(len(page))] == ["notice", "cast", "cast", "open", "programme", "programme", "notice", "programme", "heading", "other", "heading", "programme", "programme", "heading", "cast", "cast"]
    assert sections[2, 0] == "programme" and sections[3, 0] == "open"
    got = {(r.page, r.field, r.name, r.detail) for r in programme.patches(told, "page", "place", "line").collect()}
    assert got == {
        (1, "notice", "AVISO: concierto aplazado", None), (1, "performer", "Ana Ruiz", "piano"), (1, "performer", "Luis Gil", "violín"), (1, "work", "Sonata n.º 5, op. 24", "Ludwig van Beethoven"), (1, "notice", "Huelga convocada", None),
        (1, "work", "Suite BWV 1068", "J. S. Bach"), (1, "performer", "Eva Sol", "soprano"), (1, "performer", "Coro de Cámara", None), (2, "work", "Sinfonía en Re", None),
    }


def test_filters_read_the_first_value(spark):
    asked = ["?from=2024-02-30&from=2024-02-01&q=%20a+b%20", "access=%20free&era=early&format=polka&kind=alternative", "", None, "x=1", "?q=", "venue=+v%C3%A9+&area=madrid&area=nearby", "q=%E0%A4%A"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string").select("i", filters.present(F.col("a")).alias("p"), filters.told(filters.parsed(F.col("a"))).alias("t"))
    assert {r.i: (r.p, r.t) for r in df.collect()} == {0: (True, "q=a+b"), 1: (True, "era=early&kind=alternative"), 2: (False, ""), 3: (False, ""), 4: (False, ""), 5: (True, ""), 6: (True, "area=madrid&venue=v%C3%A9"), 7: (True, "")}


def test_slim_rows_and_canonical_venues(spark):
    row = dict(occurrence="o1", date=date(2024, 5, 1), time=None, access="free", formats=["organ"], eras=["early"], kind="established", area="madrid", municipality="Madrid", venue_slug="real", venue_keys=["real", "sala-2"], title="Misa", root_name="Teatro Real", space_name=None, venue_name="Sala 2", series_name=None, organizer_names=["Ente"], performer_names=None, composer_names=["Bach"], work_titles=["Misa en si"], work_composers=["Händel", None])
    kinds = "occurrence string, date date, time string, access string, formats array<string>, eras array<string>, kind string, area string, municipality string, venue_slug string, venue_keys array<string>, title string, root_name string, space_name string, venue_name string, series_name string, organizer_names array<string>, performer_names array<string>, composer_names array<string>, work_titles array<string>, work_composers array<string>"
    slim = filters.slim(spark.createDataFrame([row], kinds))
    asks = {"": 1, "q=teatro%20REAL": 1, "q=handel": 1, "composer=handel": 1, "composer=mozart": 0, "venue=sala-2": 1, "venue=otra": 0, "format=organ&era=early": 1, "format=opera": 0, "from=2024-05-02": 0, "to=2024-05-01&access=free&area=madrid": 1, "municipality=Getafe": 0}
    for query, n in asks.items():
        assert slim.withColumn("f", filters.parsed(F.lit(query))).where(filters.fits(F.col("f"))).count() == n, query
    places = spark.createDataFrame([("real", "v1", "real"), ("sala-2", "v2", "real")], "slug string, id string, root_slug string")
    asked = spark.createDataFrame([(1, "sala-2"), (2, "v1"), (3, "x"), (4, None)], "i int, venue string")
    assert {r.i: r.venue for r in filters.canonical_venue(asked, "venue", places).collect()} == {1: "real", 2: "real", 3: "x", 4: None}
