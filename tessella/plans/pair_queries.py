"""Pair verdicts and identity over the driver's tables: orders are events, their lines sessions and programme, nations places.

What an order tells is uneven, as with real listings: performers come from its lines of return flag N, works from those of line status F,
composers from those with a discount; so every branch of the musical verdict has pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text
from tessella.operators import identity, matching, places, verdicts
from tessella.sources.storage import kept, parts_for, table

from .linkage_queries import CORE, FOLDED, GRAMS, NOT_TITLES, _any_sql, _names_sql, _works_sql
from .registry import query

FACTS = ("performers", "works", "composers", "title")


def told(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: place, week and what its lines tell of performers, works, composers and title, folded."""
    o, li, s, p, c = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier", "part", "customer"))
    name = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("j "), text.fold("s_name"))).otherwise(F.concat(F.lit("juan "), F.regexp_replace("s_name", "[^0-9]", "")))
    work = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" op "), (F.col("p_size") % 5).cast("string"))).otherwise(F.col("p_name"))
    # a line tells only what counts of it, and all lines of an order meet once; sets and orders are made of them there
    lines = li.select(
        F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", (F.col("l_returnflag") == "N").alias("plays"), (F.col("l_linestatus") == "F").alias("works"),
        (F.col("l_discount") > 0.05).alias("writes"), (F.col("l_tax") > 0.04).alias("concert"),
    )
    lines = lines.join(s.select(F.col("s_suppkey").alias("l_suppkey"), name.alias("performer")), "l_suppkey")
    lines = lines.join(p.select(F.col("p_partkey").alias("l_partkey"), work.alias("work"), F.when(F.col("p_retailprice") > 950, text.fold("p_brand")).alias("composer"), "p_name"), "l_partkey")
    lines = lines.withColumns({"performer": F.when(F.col("plays"), F.col("performer")), "work": F.when(F.col("works"), F.col("work"))}).drop("plays")
    first = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "p_name", "concert").alias("first")
    lines = lines.select("k", first, "performer", "works", "work", "writes", "composer").repartition(parts_for(li), "k")
    each = lines.groupBy("k").agg(F.collect_list(F.struct("first", "performer", "works", "work", "writes", "composer")).alias("lines"))
    some = lambda of: F.array_sort(F.array_distinct(F.array_compact(F.transform("lines", of))))
    facts = each.select(
        "k", some(lambda x: x["performer"]).alias("performers"), some(lambda x: F.when(x["works"], F.struct(x["work"].alias("title"), x["composer"].alias("composer")))).alias("works"),
        some(lambda x: F.when(x["writes"], x["composer"])).alias("composers"), F.array_min(F.transform("lines", lambda x: x["first"])).alias("first"),
    )
    facts = facts.withColumn("title", F.concat(F.when(F.col("first.concert"), "Concierto de ").otherwise(""), "first.p_name")).drop("first")
    where = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"), F.col("o_custkey").alias("customer"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).join(c.select("c_custkey", F.col("c_nationkey").alias("place")), "c_custkey")
    return facts.join(where, "k").withColumn("title", text.fold("title"))


def ready(facts: Column) -> Column:
    return identity.prepared({c: facts[c] for c in FACTS})


musical = identity.prepared_verdict


def _heaviest(conflict: str, lighter: str) -> verdicts.Prepare:
    """What prepared facts can get at most: without performers and works nothing conflicts."""
    return lambda f: F.when(f["some_performers"] | f["some_works"], conflict).otherwise(lighter)


TOLD = """WITH lines AS (SELECT l_orderkey AS k, l_returnflag, l_linestatus, l_discount, l_tax, struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, d := l_shipdate, m := p_name) AS place_of,
CASE WHEN s_acctbal < 0 THEN 'j ' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) ELSE 'juan ' || regexp_replace(s_name, '[^0-9]', '', 'g') END AS performer,
CASE WHEN p_size > 25 THEN p_name || ' op ' || (p_size % 5) ELSE p_name END AS work, CASE WHEN p_retailprice > 950 THEN trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) END AS composer, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
facts AS (SELECT k, coalesce(list(DISTINCT performer) FILTER (l_returnflag = 'N'), []) AS performers, coalesce(list(DISTINCT {title: work, composer: composer}) FILTER (l_linestatus = 'F'), []) AS works,
coalesce(list(DISTINCT composer) FILTER (l_discount > 0.05 AND composer IS NOT NULL), []) AS composers, arg_min(CASE WHEN l_tax > 0.04 THEN 'Concierto de ' ELSE '' END || p_name, place_of) AS title FROM lines GROUP BY k),
told AS (SELECT facts.*, o_custkey AS customer, c_nationkey AS place, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM facts JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _works(x: str, y: str) -> str:
    """The rule for works where a composer may be unknown."""
    known = f"({x}.composer IS NOT NULL AND {y}.composer IS NOT NULL)"
    agree = f"({known} AND coalesce({_names_sql(f'{x}.composer', f'{y}.composer')}, false))"
    return _works_sql(x, y).replace(_names_sql(f"{x}.composer", f"{y}.composer"), "@agree").replace("WHEN NOT @agree THEN", f"WHEN {known} AND NOT {agree} THEN").replace("@agree", agree)


def music_sql(pairs: str) -> str:
    """CTEs that judge ``pairs`` (k and the facts of both sides as fa and fb, structs)."""
    core = lambda t: CORE.format(t)
    return f"""signs AS (SELECT *, {_any_sql('fa.works', 'fb.works', _works('x', 'y'))} AS same_works, {_any_sql('fa.performers', 'fb.performers', _names_sql('x', 'y'))} AS same_performers, {_any_sql('fa.composers', 'fb.composers', _names_sql('x', 'y'))} AS same_composers,
({core('fa.title')} = {core('fb.title')} AND length({core('fa.title')}) >= 4 AND {core('fa.title')} NOT IN ({NOT_TITLES})) AS same_title, list_has_any({GRAMS.format(FOLDED.format('fa.title'))}, {GRAMS.format(FOLDED.format('fb.title'))}) AS phrase FROM {pairs}),
music AS (SELECT *, CASE WHEN len(fa.performers) > 0 AND len(fb.performers) > 0 AND NOT same_performers AND NOT (same_works OR same_title) THEN 'conflict' WHEN same_works THEN 'match' WHEN len(fa.works) > 0 AND len(fb.works) > 0 THEN 'conflict'
WHEN same_performers THEN 'match' WHEN same_composers AND phrase THEN 'match' WHEN same_title THEN 'match' ELSE 'insufficient' END AS verdict FROM signs)"""


PAIRS = f"""{TOLD}, pairs AS (SELECT a.k AS a, b.k AS b, a.place, a.week, a.customer, a AS fa, b AS fb FROM told a JOIN told b ON a.place = b.place AND a.week = b.week AND a.k <> b.k), {music_sql('pairs')}"""


@query(f"""{PAIRS} SELECT place, strftime(week, '%Y-%m-%d') AS week, count(DISTINCT a) AS n, min(a) AS first, CASE WHEN bool_or(verdict = 'conflict') THEN 'schedule-conflict' WHEN bool_or(verdict = 'match') THEN 'schedule-duplicate' ELSE 'schedule-review' END AS code
FROM music GROUP BY place, week""")
def slot_collision_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = verdicts.slot_collisions(told(spark, sf), ["place", "week"], "k", FACTS, musical, ready)
    return out.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query(f"""{PAIRS} SELECT a AS k, CASE WHEN bool_or(verdict = 'conflict') THEN 'conflict' ELSE 'review' END AS kind FROM music WHERE verdict IN ('conflict', 'insufficient') GROUP BY a""")
def slot_hold_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.held(told(spark, sf), ["place", "week"], "k", FACTS, musical, ready, _heaviest("conflict", "insufficient"))


CUSTOMER_PAIRS = f"""{TOLD}, pairs AS (SELECT a.k AS a, b.k AS b, a.customer, a AS fa, b AS fb FROM told a JOIN told b ON a.customer = b.customer AND year(a.week) = year(b.week) AND a.k <> b.k), {music_sql('pairs')}"""


@query(f"""{CUSTOMER_PAIRS}, judged AS (SELECT customer, CASE WHEN verdict = 'conflict' THEN 'incompatible' WHEN verdict = 'insufficient' THEN 'review' ELSE 'compatible' END AS verdict FROM music)
SELECT customer, CASE WHEN bool_or(verdict = 'incompatible') THEN 'source-identity-conflict' ELSE 'source-identity-review' END AS reason FROM judged WHERE verdict <> 'compatible' GROUP BY customer""")
def group_identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders are a group, those of one year share a source identity."""
    def stated(a: Column, b: Column) -> Column:
        kind = musical(a, b)
        return F.when(kind == "conflict", "incompatible").when(kind == "insufficient", "review").otherwise("compatible")

    return verdicts.contradicted(told(spark, sf).withColumn("year", F.year("week")), "customer", ["year"], "k", FACTS, stated, ready, _heaviest("incompatible", "review"))


NEXT = f"""{TOLD}, pairs AS (SELECT a.k AS a, b.k AS b, a AS fa, b AS fb FROM (SELECT k, lead(k) OVER (PARTITION BY place, week ORDER BY k) AS next FROM told) n JOIN told a ON a.k = n.k JOIN told b ON b.k = n.next), {music_sql('pairs')}"""


@query(f"""{NEXT} SELECT a, b, verdict, same_works, same_performers, same_composers, same_title FROM music""")
def musical_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Each order and the next one of its place and week: the verdict and what it rests on, for all its branches."""
    t = told(spark, sf).select("place", "week", "k", F.struct(*FACTS).alias("f")).repartition("place", "week").withColumn("f", ready(F.col("f")))
    nxt = Window.partitionBy("place", "week").orderBy("k")
    pairs = t.select(F.col("k").alias("a"), F.col("f").alias("fa"), F.lead(F.struct("k", "f")).over(nxt).alias("next")).where("next is not null")
    a, b = F.col("fa"), F.col("next.f")
    return pairs.select(
        "a", F.col("next.k").alias("b"), musical(a, b).alias("verdict"), identity.same_works(a, b).alias("same_works"), identity.same_names(a, b, "performers").alias("same_performers"),
        identity.same_names(a, b, "composers").alias("same_composers"), identity.same_title(a, b).alias("same_title"),
    )


def _sides(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Orders of status P as observations, the others as published events, with sessions, citations, aliases and places."""
    o, li, c, n = (table(spark, sf, t) for t in ("orders", "lineitem", "customer", "nation"))
    quarter = lambda day: F.concat_ws("/", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.year(day).cast("string"), F.quarter(day).cast("string"))
    place = F.when(F.col("c_acctbal") < 0, 100 + F.col("n_regionkey")).otherwise(F.col("c_nationkey"))
    about = o.withColumn("c_custkey", F.col("o_custkey")).join(c, "c_custkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "postponed").when(F.col("o_orderpriority") == "2-HIGH", "cancelled").otherwise("scheduled")
    site = F.concat(F.lit("://www."), "c_mktsegment", F.lit(".example/evento/"), "o_custkey", F.lit("-"), F.year("o_orderdate"))
    about = about.select(
        F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice", F.lower("c_mktsegment").alias("source"), quarter(F.col("o_orderdate")).alias("external"), quarter(F.date_add(F.to_date("o_orderdate"), 90)).alias("next"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("HTTPS"), site, F.lit("/#top"))).otherwise(F.concat(F.lit("https"), site)).alias("url"), place.cast("int").alias("at"), status.alias("status"),
    )
    facts = told(spark, sf).select("k", *FACTS)
    rows = kept(about.join(facts, "k").withColumnRenamed("at", "place"))  # both sides are asked for again and again
    time = F.when(F.col("l_returnflag") != "N", F.when(F.col("l_quantity") > 25, "20:00").otherwise("18:00"))
    sessions = li.select(F.col("l_orderkey").alias("k"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), time.alias("time"), "l_tax", "l_linenumber").join(o.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k")
    seen, known = F.col("o_orderstatus") == "P", F.col("o_orderstatus") != "P"
    events = rows.where(known).withColumnRenamed("k", "event")
    places = n.select(F.col("n_nationkey").alias("place"), (100 + F.col("n_regionkey")).cast("int").alias("parent"))
    return {
        "observed": rows.where(seen).withColumnRenamed("k", "id"), "sessions": sessions.where(seen).select(F.col("k").alias("id"), "date", "time"), "published": events, "published_sessions": sessions.where(known).select(F.col("k").alias("event"), "date", "time"),
        "cited": events.select("event", "source", "external", "url"), "places": places,
        "aliases": events.where("o_totalprice > 400000").join(sessions.where(known).groupBy(F.col("k").alias("event")).agg(F.min("date").alias("date")), "event").select("event", "source", F.col("next").alias("external"), F.lit(None).cast("string").alias("url"), F.when(F.col("o_totalprice") > 450000, F.col("date")).alias("date")),
    }


SIDES = f"""{TOLD}, about AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice, lower(c_mktsegment) AS source, 'c' || o_custkey || '/' || year(o_orderdate) || '/' || quarter(o_orderdate) AS external,
'c' || o_custkey || '/' || year(CAST(o_orderdate AS DATE) + 90) || '/' || quarter(CAST(o_orderdate AS DATE) + 90) AS next, lower(c_mktsegment) || o_custkey || '-' || year(o_orderdate) AS url,
CASE WHEN c_acctbal < 0 THEN 100 + n_regionkey ELSE c_nationkey END AS at, CASE WHEN c_acctbal >= 0 THEN 100 + n_regionkey END AS up, CASE o_orderpriority WHEN '1-URGENT' THEN 'postponed' WHEN '2-HIGH' THEN 'cancelled' ELSE 'scheduled' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
row_of AS (SELECT about.*, told.* EXCLUDE (k, place, week, customer, title), {FOLDED.format('told.title')} AS title FROM about JOIN told USING (k)),
sess AS (SELECT DISTINCT l_orderkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_quantity > 25 THEN '20:00' ELSE '18:00' END END AS time FROM lineitem),
ob AS (SELECT * FROM row_of WHERE o_orderstatus = 'P'), ev AS (SELECT * FROM row_of WHERE o_orderstatus <> 'P'),
os AS (SELECT sess.* FROM sess JOIN ob USING (k)), es AS (SELECT sess.* FROM sess JOIN ev USING (k)),
alias AS (SELECT ev.k, source, next, CASE WHEN o_totalprice > 450000 THEN (SELECT min(date) FROM es WHERE es.k = ev.k) END AS date FROM ev WHERE o_totalprice > 400000),
ties AS (SELECT DISTINCT o.k AS a, e.k AS b, 'external-id' AS method, false AS dated_alias FROM ob o JOIN ev e ON o.source = e.source AND o.external = e.external
UNION SELECT o.k, e.k, 'url', false FROM ob o JOIN ev e ON o.url = e.url),
al AS (SELECT o.k AS a, l.k AS b, max(l.date IS NOT NULL) AS dated_alias FROM ob o JOIN alias l ON o.source = l.source AND o.external = l.next WHERE l.date IS NULL OR EXISTS (SELECT 1 FROM os WHERE os.k = o.k AND os.date = l.date) GROUP BY ALL),
st AS (SELECT DISTINCT o.k AS a, e.k AS b FROM ob o JOIN os ON os.k = o.k JOIN es ON os.date = es.date AND (os.time IS NULL OR es.time IS NULL OR os.time = es.time) JOIN ev e ON e.k = es.k AND e.at = o.at AND e.title = o.title),
want AS (SELECT a, b FROM ties UNION SELECT a, b FROM al UNION SELECT a, b FROM st UNION SELECT * FROM (SELECT DISTINCT o.k, e.k FROM ob o JOIN os ON os.k = o.k JOIN es ON os.date = es.date AND os.time = es.time JOIN ev e ON e.k = es.k AND e.at = o.at AND e.status <> 'cancelled')),
both_ AS (SELECT a, b, o.at AS oat, o.up AS oup, e.at AS eat, e.up AS eup, o.status, o AS fa, e AS fb FROM want JOIN ob o ON o.k = a JOIN ev e ON e.k = b), {music_sql('both_')},
untitled AS (SELECT *, CASE WHEN len(fa.performers) > 0 AND len(fb.performers) > 0 AND NOT same_performers AND NOT same_works THEN 'conflict' WHEN same_works THEN 'match' WHEN len(fa.works) > 0 AND len(fb.works) > 0 THEN 'conflict' ELSE '' END AS bare FROM music),
hits AS (SELECT * FROM ties UNION ALL SELECT a, b, 'alias', dated_alias FROM al UNION ALL SELECT a, b, 'strong', false FROM st JOIN untitled USING (a, b) WHERE bare <> 'conflict'),
met AS (SELECT h.a, h.b, es.date, es.time AS pt, max(os.time IS NOT DISTINCT FROM es.time OR es.time IS NULL OR (os.time IS NULL AND (SELECT count(*) FROM es x WHERE x.k = h.b AND x.date = es.date) = 1)) AS fits,
max(os.time IS NULL OR es.time IS NULL OR os.time = es.time) AS slot FROM (SELECT DISTINCT a, b FROM hits) h JOIN os ON os.k = h.a JOIN es ON es.k = h.b AND es.date = os.date GROUP BY ALL),
near AS (SELECT a, b, count(*) FILTER (fits) AS fits, max(slot) AS slot FROM met GROUP BY ALL),
dates AS (SELECT h.a, h.b, n.a IS NOT NULL AS same_date, coalesce(n.slot, false) AS same_slot, coalesce(n.fits, 0) = (SELECT count(*) FROM es WHERE es.k = h.b) AS covers FROM (SELECT DISTINCT a, b FROM hits) h LEFT JOIN near n USING (a, b)),
facts_ AS (SELECT d.*, u.verdict AS music, u.status, (u.verdict = 'match' OR u.same_title) AS continuity, CASE WHEN oat = eat THEN 'same' WHEN oup = eat THEN 'refinement' WHEN eup = oat THEN 'coarser' WHEN oup = eup THEN 'sibling' ELSE 'unrelated' END AS place FROM dates d JOIN untitled u USING (a, b)),
ruled AS (SELECT *, CASE WHEN status = 'postponed' AND music = 'conflict' THEN 'review' WHEN music = 'conflict' AND NOT same_date THEN 'incompatible' WHEN music = 'conflict' THEN CASE WHEN NOT same_slot THEN 'incompatible' ELSE 'review' END
WHEN status = 'cancelled' AND NOT (covers AND place IN ('same', 'refinement')) THEN 'review' WHEN place = 'coarser' THEN CASE WHEN music = 'match' AND same_slot AND status <> 'cancelled' THEN 'compatible' ELSE 'review' END
WHEN place NOT IN ('same', 'refinement') THEN CASE WHEN continuity AND status = 'postponed' THEN 'compatible' WHEN NOT same_date THEN 'incompatible' ELSE 'review' END
WHEN same_slot THEN 'compatible' WHEN continuity AND (same_date OR status = 'postponed') THEN 'compatible' ELSE 'review' END AS told FROM facts_),
weighed AS (SELECT h.*, r.same_date, h.method IN ('external-id', 'url') AS guarded, CASE WHEN h.method IN ('external-id', 'url') THEN r.told ELSE 'compatible' END AS told, list_position(['external-id', 'url', 'alias', 'strong'], h.method) AS rank FROM hits h JOIN ruled r USING (a, b)),
per AS (SELECT a, b, min(rank) FILTER (told = 'compatible') AS accepted, CASE WHEN NOT bool_or(dated_alias) THEN min(rank) FILTER (told = 'review') END AS doubted, bool_or(told = 'compatible' AND method = 'external-id') AS by_id, bool_or(method = 'strong') AS strong,
bool_or(told = 'incompatible' AND method = 'external-id') AS stale, bool_or(same_date) AS owns, bool_or(guarded) AS guarded FROM weighed GROUP BY a, b),
flags AS (SELECT *, bool_or(by_id) OVER (PARTITION BY a) AS any_id, bool_or(accepted IS NOT NULL AND guarded AND owns) OVER (PARTITION BY a) AS owner FROM per),
marked AS (SELECT *, accepted IS NOT NULL AND (NOT owner OR NOT guarded OR owns) AS fit, doubted IS NOT NULL AND (NOT owner OR owns) AS open, stale AND NOT any_id AS old FROM flags),
over_ AS (SELECT DISTINCT a FROM (SELECT m.a, os.date, os.time, count(DISTINCT m.b) AS owners FROM marked m JOIN os ON os.k = m.a JOIN es ON es.k = m.b AND es.date = os.date AND (os.time IS NULL OR es.time IS NULL OR os.time = es.time) WHERE m.fit GROUP BY ALL) WHERE owners > 1),
summed AS (SELECT a, count(*) FILTER (fit) AS fits, count(*) FILTER (open) AS opens, count(*) FILTER (fit OR open) AS n, arg_min(b, (least(accepted, doubted), b)) FILTER (fit OR open) AS best, min(least(accepted, doubted)) FILTER (fit OR open) AS best_rank,
arg_min(b, (accepted, b)) FILTER (fit) AS sure, min(accepted) FILTER (fit) AS sure_rank, max(accepted) FILTER (fit) AS weakest, list(b) FILTER (old) AS olds, list(b) FILTER (strong) AS news FROM marked GROUP BY a),
staled AS (SELECT *, coalesce(len(list_filter(olds, lambda x: len(list_filter(news, lambda y: y <> x)) > 0)) > 0, false) AS is_stale FROM summed),
ends AS (SELECT s.*, CASE WHEN is_stale THEN 'identifier of another event' WHEN opens > 0 THEN 'source identity in doubt' WHEN fits > 1 AND weakest > 3 THEN 'several plausible events' WHEN fits > 1 AND a IN (SELECT a FROM over_) THEN 'several events on the same dates' END AS reason FROM staled s),
first_ AS (SELECT a AS id, CASE WHEN reason IS NOT NULL THEN 'ambiguous' WHEN fits > 1 THEN 'matched-many' ELSE 'matched' END AS action, ['external-id', 'url', 'alias', 'strong'][CASE WHEN is_stale THEN 1 WHEN opens > 0 THEN best_rank ELSE sure_rank END] AS method,
CASE WHEN is_stale THEN list_min(list_concat(olds, news)) WHEN opens > 0 THEN best ELSE sure END AS event, CASE WHEN is_stale THEN len(list_distinct(list_concat(olds, news))) WHEN opens > 0 THEN n ELSE fits END AS n, reason FROM ends WHERE reason IS NOT NULL OR fits > 0),
slot_ AS (SELECT DISTINCT o.k AS a, e.k AS b, u.verdict AS music FROM ob o JOIN os ON os.k = o.k JOIN es ON os.date = es.date AND os.time = es.time JOIN ev e ON e.k = es.k AND e.at = o.at AND e.status <> 'cancelled' JOIN untitled u ON u.a = o.k AND u.b = e.k WHERE o.k NOT IN (SELECT id FROM first_)),
slotted AS (SELECT a, count(*) FILTER (music = 'match') AS m, count(*) FILTER (music = 'conflict') AS c, count(*) FILTER (music = 'insufficient') AS i, min(b) FILTER (music = 'match') AS bm, min(b) FILTER (music = 'conflict') AS bc, min(b) FILTER (music = 'insufficient') AS bi FROM slot_ GROUP BY a),
second_ AS (SELECT a AS id, CASE WHEN m = 1 AND c = 0 THEN 'matched' ELSE 'ambiguous' END AS action, 'slot' AS method, coalesce(bm, bc, bi) AS event, CASE WHEN m + c > 0 THEN m + c ELSE i END AS n, CASE WHEN m = 1 AND c = 0 THEN NULL WHEN c > 0 AND m = 0 THEN 'schedule-conflict' WHEN m > 0 THEN 'several events in the slot' ELSE 'schedule-review' END AS reason FROM slotted)"""


@query(f"""{SIDES} SELECT ob.k AS id, coalesce(x.action, 'unmatched') AS action, x.method, x.event, x.n, x.reason FROM ob LEFT JOIN (SELECT * FROM first_ UNION ALL SELECT * FROM second_) x ON x.id = ob.k""")
def identity_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    return matching.matched(**_sides(spark, sf))


def _rounds_sql(most: int) -> str:
    """Names in rounds: first of each root, then the next numbers of each root, those that are free to the first that asks."""
    parts = ["r0 AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') || CASE WHEN p_size <= 20 THEN '-' || p_size ELSE '' END AS root FROM part)", "used0 AS (SELECT DISTINCT replace(p_name, ' ', '-') || '-' || p_size AS name FROM part WHERE p_size BETWEEN 2 AND 6)",
             "won0 AS (SELECT min(id) AS id, root AS name FROM r0 WHERE root NOT IN (SELECT name FROM used0) GROUP BY root)", "open0 AS (SELECT * FROM r0 WHERE id NOT IN (SELECT id FROM won0))",
             "asked0 AS (SELECT regexp_replace(name, '-[0-9]+$', '') AS root, max(CAST(regexp_extract(name, '-([1-9][0-9]{0,8})$', 1) AS BIGINT)) AS reached FROM used0 GROUP BY 1)", "all0 AS (SELECT name FROM used0 UNION SELECT name FROM won0)"]
    for i in range(1, most + 1):
        j = i - 1
        parts += [
            f"try{i} AS (SELECT id, root, place + greatest(coalesce(reached, 1), 1) AS number, root || '-' || (place + greatest(coalesce(reached, 1), 1)) AS name FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS place FROM open{j}) LEFT JOIN asked{j} USING (root))",
            f"won{i} AS (SELECT min(id) AS id, name FROM try{i} WHERE name NOT IN (SELECT name FROM all{j}) GROUP BY name)", f"open{i} AS (SELECT id, root FROM try{i} WHERE id NOT IN (SELECT id FROM won{i}))",
            f"asked{i} AS (SELECT root, max(number) AS reached FROM try{i} GROUP BY root)", f"all{i} AS (SELECT name FROM all{j} UNION SELECT name FROM won{i})",
        ]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id AS p_partkey, name AS slug FROM won{i}" for i in range(most + 1))


@query(_rounds_sql(8))
def collision_free_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, some of which end in a number themselves, beside names that are taken."""
    p = table(spark, sf, "part")
    base = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    taken = p.where("p_size between 2 and 6").select(F.concat_ws("-", base, "p_size").alias("slug")).distinct()
    fresh = p.select("p_partkey", F.concat_ws("-", base, F.when(F.col("p_size") <= 20, F.col("p_size")).cast("string")).alias("root"))
    return places.unique_names(fresh, F.col("root"), taken, "slug", ["p_partkey"]).select("p_partkey", "slug")
