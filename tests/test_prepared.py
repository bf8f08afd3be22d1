"""Musical verdicts of prepared facts against names, works and titles compared pair by pair."""

import random

from pyspark.sql import functions as F

from tessella.operators import composers, identity, verdicts

NAMES = ["ana ruiz", "a ruiz", "anaruiz", "luis gil", "l gil", "maria ruiz", "orquesta de camara", "camara", "orquesta de camara de madrid", "trio", "filarmonica", "la filarmonica", "", "z ruizo", "ana ruizo"]
WORKS = ["sonata op 3", "sonata", "sonata k 5", "noche de verano", "noche de verano en el parque", "noche", "misa op 3", "verano bwv 12a", "op 3", ""]
TITLES = ["concierto de noche de verano", "noche de verano", "recital", "gala", "noche de luna", "", "luna de verano"]
SCHEMA = "k int, performers array<string>, works array<struct<title:string,composer:string>>, composers array<string>, title string"
FACTS = ("performers", "works", "composers", "title")


def rows(n, seed):
    r = random.Random(seed)
    some = lambda of, most: [r.choice(of) for _ in range(r.randrange(most))]
    return [(k, some(NAMES, 3), [(w, r.choice([*NAMES, None])) for w in some(WORKS, 3)], some(NAMES, 3), r.choice(TITLES)) for k in range(n)]


def spelled(a, b):
    """The verdict as its rules say it, pair by pair."""
    works, performers, composers = identity.any_agree(a["works"], b["works"], identity.works_agree), identity.any_agree(a["performers"], b["performers"]), identity.any_agree(a["composers"], b["composers"])
    title, some = identity.titles_agree(a["title"], b["title"]), lambda c: (F.size(a[c]) > 0) & (F.size(b[c]) > 0)
    out = F.when(some("performers") & ~performers & ~(works | title), "conflict").when(works, "match").when(some("works"), "conflict").when(performers, "match")
    return out.when(composers & identity.shared_phrase(a["title"], b["title"]), "match").when(title, "match").otherwise("insufficient")


def test_prepared_facts_give_the_verdict_of_pairs(spark):
    df = spark.createDataFrame(rows(130, 5), SCHEMA).select("k", F.struct(*FACTS).alias("f"))
    made = df.select("k", "f", identity.prepared({c: F.col("f")[c] for c in FACTS}).alias("m")).localCheckpoint()
    both = made.select("k", F.col("f").alias("fa"), F.col("m").alias("ma")).crossJoin(made.select(F.col("k").alias("j"), F.col("f").alias("fb"), F.col("m").alias("mb")))
    a, b = F.col("ma"), F.col("mb")
    bare = {"title": F.lit("")}
    got = both.select(
        spelled(F.col("fa"), F.col("fb")).alias("want"), identity.prepared_verdict(a, b).alias("got"), spelled(F.col("fa").withField("title", F.lit("")), F.col("fb").withField("title", bare["title"])).alias("bare"),
        identity.prepared_verdict(a, b, titles=False).alias("untitled"), "fa", "fb",
    ).collect()
    assert [(r.fa, r.fb, r.want, r.got) for r in got if r.want != r.got] == []
    assert [(r.fa, r.fb) for r in got if r.bare != r.untitled] == []
    assert {r.want for r in got} == {"match", "conflict", "insufficient"}


def test_blocks_judge_prepared_facts(spark):
    df = spark.createDataFrame([(b, *row) for b in ("x", "y") for row in rows(25, len(b) + ord(b))], "b string, " + SCHEMA)
    plain = verdicts.held(df, ["b"], "k", FACTS, spelled)
    ready = verdicts.held(df, ["b"], "k", FACTS, identity.prepared_verdict, lambda f: identity.prepared({c: f[c] for c in FACTS}))
    assert sorted(map(tuple, ready.collect())) == sorted(map(tuple, plain.collect())) != []


def test_composers_are_looked_up_once_a_spelling(spark):
    """Rows that repeat a few spellings: each row is told by its own, rows of equal ids too."""
    names = ["Ana Ruiz", "Música de Ana Ruiz", "Luis Gil", None]
    data = spark.createDataFrame([(i // 2, names[i % 4]) for i in range(400)], "k int, n string")
    known = spark.createDataFrame([("Ana Ruiz", "RUIZ, Ana")], "alias string, name string")
    got = composers.identified(data, ["k"], "n", known, "alias", "name")
    want = {"Ana Ruiz": ("RUIZ, Ana", "alias", "RUIZ, Ana"), "Música de Ana Ruiz": ("RUIZ, Ana", "alias", "RUIZ, Ana"), "Luis Gil": (None, None, "luis gil"), None: (None, None, None)}
    told = got.collect()
    assert len(told) == 400
    assert all((r.composer, r.stage, r.identity) == want[r.n] for r in told)
