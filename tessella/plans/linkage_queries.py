"""Identity, merge and publication over the driver's tables: orders are events, their lines sessions, nations places, parts works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text
from tessella.operators import accounting, identity, linkage, observe, reconcile
from tessella.operators.components import components
from tessella.sources.storage import parts_for, table

from .registry import query

TODAY, LAST = "2001-01-01", "2001-06-30"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: performers, works and composers of its lines (folded), and a title from its first line."""
    li, s, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("j "), text.fold("s_name"))).otherwise(F.concat(F.lit("juan "), F.regexp_replace("s_name", "[^0-9]", "")))
    work = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" op "), (F.col("p_size") % 5).cast("string"))).otherwise(F.col("p_name"))
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(s.select(F.col("s_suppkey").alias("l_suppkey"), name.alias("performer")), "l_suppkey")
    rows = rows.join(p.select(F.col("p_partkey").alias("l_partkey"), work.alias("title"), text.fold("p_brand").alias("composer"), "p_name"), "l_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set("performer").alias("performers"), F.collect_set(F.struct("title", "composer")).alias("works"), F.collect_set("composer").alias("composers"),
        F.min_by(F.concat(F.when(F.col("l_orderkey") % 2 == 0, "Concierto de ").otherwise(""), "p_name"), F.struct("l_linenumber", "p_name")).alias("title"),
    )


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each order and the next one on the same day in the same nation, as (a, b)."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    slot = Window.partitionBy("c_nationkey", "day").orderBy("o_orderkey")
    rows = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).join(c.select("c_custkey", "c_nationkey"), "c_custkey")
    return rows.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(slot).alias("b")).where("b is not null")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on each order and the next one of its slot; what orders tell goes once to their slot and is prepared there."""
    o, c, f = table(spark, sf, "orders"), table(spark, sf, "customer"), _facts(spark, sf)
    rows = o.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).join(c.select("c_custkey", "c_nationkey"), "c_custkey")
    rows = rows.join(f.select(F.col("k").alias("a"), F.struct("performers", "works", "composers", "title").alias("f")), "a", "left").repartition("c_nationkey", "day")
    side = {x: F.col(f"f.{x}") for x in ("performers", "works", "composers")} | {"title": text.fold(F.col("f.title"))}
    # a plain struct, since the optimizer takes its fields one by one
    rows = rows.select("a", "c_nationkey", "day", F.col("f").isNotNull().alias("told"), identity.prepared(side).alias("f"))
    nxt = Window.partitionBy("c_nationkey", "day").orderBy("a")
    pairs = rows.select("a", F.col("f").alias("fa"), F.col("told"), F.lead(F.struct("a", "told", "f")).over(nxt).alias("next")).where("told and next.told")
    return pairs.select("a", F.col("next.a").alias("b"), identity.prepared_verdict(F.col("fa"), F.col("next.f")).alias("verdict"))


def _names_sql(x: str, y: str) -> str:
    short, long = f"(CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END)", f"(CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END)"
    last, first = (lambda z: f"split_part({z}, ' ', -1)"), (lambda z: f"split_part({z}, ' ', 1)")
    initial = f"({first(x)} = {first(y)} OR (length({first(x)}) = 1 AND starts_with({first(y)}, {first(x)})) OR (length({first(y)}) = 1 AND starts_with({first(x)}, {first(y)})))"
    inside = f"(contains(' ' || {long} || ' ', ' ' || {short} || ' ') AND (length({short}) >= 10 OR contains({short}, ' ')))"
    people = f"(contains({x}, ' ') AND contains({y}, ' ') AND {last(x)} = {last(y)} AND length({last(x)}) >= 4 AND {initial})"
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR replace({x}, ' ', '') = replace({y}, ' ', '') OR {inside} OR {people}))"


def _works_sql(x: str, y: str) -> str:
    number = lambda z: f"list_transform(regexp_extract_all({z}.title, '\\b(?:op|bwv|kv?|hob|d|rv|hwv|woo)\\s*[0-9]+[a-z]?\\b'), lambda n: replace(n, ' ', ''))"
    core = lambda z: f"trim(regexp_replace(regexp_replace({z}.title, '\\b(?:op|bwv|kv?|hob|d|rv|hwv|woo)\\s*[0-9]+[a-z]?\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    composers, m, n, p, q = _names_sql(f"{x}.composer", f"{y}.composer"), number(x), number(y), core(x), core(y)
    generic = ", ".join(f"'{g}'" for g in identity.GENERIC)
    return f"CASE WHEN NOT {composers} THEN false WHEN list_has_any({m}, {n}) THEN true WHEN len({m}) > 0 AND len({n}) > 0 THEN false WHEN {p} = {q} AND {p} <> '' THEN ({p} NOT IN ({generic}) OR {composers}) ELSE least(length({p}), length({q})) >= 12 AND (contains({p}, {q}) OR contains({q}, {p})) END"


def _any_sql(a: str, b: str, agree: str) -> str:
    return f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: {agree})) > 0)) > 0"


CORE = f"trim(regexp_replace(trim(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g')), '^(?:(?:{'|'.join(identity.ACTIVITIES)})(?: (?:de|del|of|extraordinario))?(?: |$))+', ''))"
NOT_TITLES = ", ".join(f"'{x}'" for x in (*identity.GENERIC, *identity.ACTIVITIES))
GRAMS = "list_transform(range(1, greatest(1, len(string_split({0}, ' ')))), lambda i: string_split({0}, ' ')[i] || ' ' || string_split({0}, ' ')[i + 1])"
FOLDED = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
FACTS = """WITH rows AS (SELECT l_orderkey AS k, l_linenumber, CASE WHEN s_suppkey % 3 = 0 THEN 'j ' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) ELSE 'juan ' || regexp_replace(s_name, '[^0-9]', '', 'g') END AS performer,
CASE WHEN p_partkey % 2 = 0 THEN p_name || ' op ' || (p_size % 5) ELSE p_name END AS work, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS composer, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
facts AS (SELECT k, list(DISTINCT performer) AS performers, list(DISTINCT {title: work, composer: composer}) AS works, list(DISTINCT composer) AS composers,
(CASE WHEN k % 2 = 0 THEN 'Concierto de ' ELSE '' END) || arg_min(p_name, (l_linenumber, p_name)) AS title FROM rows GROUP BY k),
slots AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY c_nationkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS b FROM orders JOIN customer ON o_custkey = c_custkey),
pairs AS (SELECT a, b, fa.performers AS pa, fb.performers AS pb, fa.works AS wa, fb.works AS wb, fa.composers AS ca, fb.composers AS cb, fa.title AS ta, fb.title AS tb FROM slots JOIN facts fa ON fa.k = a JOIN facts fb ON fb.k = b)"""
MUSIC = f"""{FACTS}, told AS (SELECT a, b, {_any_sql('wa', 'wb', _works_sql('x', 'y'))} AS works, {_any_sql('pa', 'pb', _names_sql('x', 'y'))} AS performers, {_any_sql('ca', 'cb', _names_sql('x', 'y'))} AS composers,
({CORE.format('ta')} = {CORE.format('tb')} AND length({CORE.format('ta')}) >= 4 AND {CORE.format('ta')} NOT IN ({NOT_TITLES})) AS title, list_has_any({GRAMS.format(FOLDED.format('ta'))}, {GRAMS.format(FOLDED.format('tb'))}) AS phrase FROM pairs),
music AS (SELECT a, b, CASE WHEN NOT performers AND NOT (works OR title) THEN 'conflict' WHEN works THEN 'match' WHEN true THEN 'conflict' WHEN performers THEN 'match' WHEN composers AND phrase THEN 'match' WHEN title THEN 'match' ELSE 'insufficient' END AS verdict FROM told)"""


@query(f"{MUSIC} SELECT a, b, verdict FROM music")
def musical_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)


@query(f"{FACTS} SELECT a, b, ({CORE.format('ta')} = {CORE.format('tb')} AND length({CORE.format('ta')}) >= 4 AND {CORE.format('ta')} NOT IN ({NOT_TITLES})) AS agree FROM pairs")
def editorial_titles(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).select("k", "title")
    pairs = _pairs(spark, sf).join(f.select(F.col("k").alias("a"), F.col("title").alias("ta")), "a").join(f.select(F.col("k").alias("b"), F.col("title").alias("tb")), "b")
    return pairs.select("a", "b", identity.titles_agree(F.col("ta"), F.col("tb")).alias("agree"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Pair features from two lines of one order: the first as observed, the second as published."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    nxt = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "day")
    pair = li.withColumn("q", F.lead(F.struct("l_partkey", "l_suppkey", "day", "l_linestatus")).over(nxt)).where("q is not null and l_linenumber = 1")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    q = lambda c: F.col(f"q.{c}")
    music = F.when(p % 4 == q("l_partkey") % 4, "match").when((p + q("l_partkey")) % 3 == 0, "conflict").otherwise("insufficient")
    place = linkage.venue_relation(s % 5, F.when(s % 5 > 1, s % 2), q("l_suppkey") % 5, F.when(q("l_suppkey") % 5 > 1, q("l_suppkey") % 2))
    same_date = F.abs(F.datediff("day", q("day"))) < 40
    status = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "postponed").otherwise("scheduled")
    return pair.select("l_orderkey", "l_partkey", "day", music.alias("music"), place.alias("place"), (same_date & (s % 2 == 0)).alias("same_slot"), same_date.alias("same_date"), F.lit(True).alias("dated"), status.alias("status"), (q("l_linestatus") == F.col("l_linestatus")).alias("continuity"), (p % 2 == 0).alias("covers"))


FEATURES = """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s, l_linestatus AS ls, l_returnflag AS rf, CAST(l_shipdate AS DATE) AS day FROM lineitem),
nx AS (SELECT *, lead(p) OVER w AS qp, lead(s) OVER w AS qs, lead(day) OVER w AS qd, lead(ls) OVER w AS ql FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, p, s, day)),
pr AS (SELECT *, s % 5 AS av, CASE WHEN s % 5 > 1 THEN s % 2 END AS ap, qs % 5 AS bv, CASE WHEN qs % 5 > 1 THEN qs % 2 END AS bp FROM nx WHERE qp IS NOT NULL AND l_linenumber = 1),
features AS (SELECT l_orderkey, p, day, CASE WHEN p % 4 = qp % 4 THEN 'match' WHEN (p + qp) % 3 = 0 THEN 'conflict' ELSE 'insufficient' END AS music,
CASE WHEN av = bv THEN 'same' WHEN ap = bv THEN 'refinement' WHEN bp = av THEN 'coarser' WHEN ap = bp THEN 'sibling' ELSE 'unrelated' END AS place, abs(datediff('day', day, qd)) < 40 AND s % 2 = 0 AS same_slot, abs(datediff('day', day, qd)) < 40 AS same_date,
CASE rf WHEN 'R' THEN 'cancelled' WHEN 'A' THEN 'postponed' ELSE 'scheduled' END AS status, ql = ls AS continuity, p % 2 = 0 AS covers FROM pr),
source AS (SELECT *, CASE WHEN status = 'postponed' AND music = 'conflict' THEN 'review' WHEN music = 'conflict' AND NOT same_date THEN 'incompatible' WHEN music = 'conflict' THEN CASE WHEN NOT same_slot THEN 'incompatible' ELSE 'review' END
WHEN status = 'cancelled' AND NOT (covers AND place IN ('same', 'refinement', 'absent')) THEN 'review' WHEN place = 'coarser' THEN CASE WHEN music = 'match' AND same_slot AND status <> 'cancelled' THEN 'compatible' ELSE 'review' END
WHEN place NOT IN ('same', 'refinement', 'absent') THEN CASE WHEN continuity AND status = 'postponed' THEN 'compatible' WHEN NOT same_date THEN 'incompatible' ELSE 'review' END
WHEN same_slot THEN 'compatible' WHEN continuity AND (same_date OR status = 'postponed') THEN 'compatible' ELSE 'review' END AS verdict,
CASE WHEN music = 'match' AND place IN ('same', 'refinement') AND same_slot THEN 'compatible' WHEN music = 'conflict' OR place IN ('unrelated', 'sibling') THEN 'incompatible' ELSE 'review' END AS strict FROM features)"""
COLUMNS = ("music", "place", "same_slot", "same_date", "dated", "status", "continuity", "covers")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    strict = identity.recyclable_verdict(F.col("music"), F.col("place"), F.col("same_slot"))
    return f.withColumns({"verdict": identity.source_verdict(*map(F.col, COLUMNS)), "strict": strict})


@query(f"{FEATURES} SELECT l_orderkey, place, status, verdict, strict FROM source")
def source_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select("l_orderkey", "place", "status", "verdict", "strict")


@query(f"""{FEATURES}, hits AS (SELECT l_orderkey, l_orderkey % 7 AS event, 'url' AS method, verdict, same_date AS owns_date, NOT same_slot AS ov FROM source WHERE l_orderkey % 3 <> 0
UNION ALL SELECT l_orderkey, p % 7, CASE WHEN p % 2 = 0 THEN 'external-id' ELSE 'strong' END, CASE WHEN p % 2 = 0 THEN verdict ELSE 'compatible' END, covers, same_slot FROM source WHERE l_orderkey % 4 <> 0),
owned AS (SELECT *, max(CAST(owns_date AS INT)) OVER (PARTITION BY l_orderkey) AS owned FROM hits WHERE verdict <> 'incompatible'),
found AS (SELECT l_orderkey, count(DISTINCT event) AS n, min(event) AS event, arg_min(method, (list_position(['external-id', 'url', 'alias', 'strong'], method), event)) AS method, count(*) FILTER (method NOT IN ('external-id', 'url')) AS unsure,
count(*) FILTER (verdict = 'review') AS reviews, count(*) FILTER (ov) AS ovs FROM owned WHERE owned = 0 OR owns_date GROUP BY l_orderkey),
held AS (SELECT l_orderkey, count(*) FILTER (music = 'match') AS matches, count(*) FILTER (music = 'conflict') AS conflicts, min(p % 7) FILTER (music = 'match') AS match, count(DISTINCT p % 7) AS n, min(p % 7) AS least FROM source WHERE same_slot AND l_orderkey NOT IN (SELECT l_orderkey FROM found) GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN reviews > 0 THEN 'ambiguous' WHEN n = 1 THEN 'matched' WHEN unsure > 0 OR ovs > 0 THEN 'ambiguous' ELSE 'matched-many' END AS action, method, event, n FROM found
UNION ALL SELECT l_orderkey, CASE WHEN matches = 1 AND conflicts = 0 THEN 'matched' ELSE 'ambiguous' END, 'slot', coalesce(match, least), n FROM held""")
def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf)
    p, k = F.col("l_partkey"), F.col("l_orderkey")
    by_url = v.where(k % 3 != 0).select("l_orderkey", (k % 7).alias("event"), F.lit("url").alias("method"), "verdict", F.col("same_date").alias("owns_date"), (~F.col("same_slot")).alias("overlaps"))
    by_other = v.where(k % 4 != 0).select(
        "l_orderkey", (p % 7).alias("event"), F.when(p % 2 == 0, "external-id").otherwise("strong").alias("method"), F.when(p % 2 == 0, F.col("verdict")).otherwise("compatible").alias("verdict"),
        F.col("covers").alias("owns_date"), F.col("same_slot").alias("overlaps"),
    )
    slots = v.where("same_slot").select("l_orderkey", (p % 7).alias("event"), "music")
    return identity.resolve(by_url.unionByName(by_other), slots, "l_orderkey")


ROUTED = """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'matched' WHEN 2 THEN 'matched-many' ELSE 'unmatched' END AS action,
CASE WHEN o_orderkey % 11 = 0 THEN 'sin título' WHEN o_orderkey % 13 = 0 THEN 'sin fecha' WHEN CAST(o_orderdate AS DATE) < DATE '2000-01-01' THEN 'fecha pasada' WHEN CAST(o_orderdate AS DATE) > DATE '2001-06-30' THEN 'fuera de ventana' END AS skip,
CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'exclude' WHEN '5-LOW' THEN 'uncertain' ELSE 'include' END AS eligibility FROM orders),
routed AS (SELECT *, CASE WHEN action = 'ambiguous' THEN 'ambiguous' WHEN action = 'matched' THEN 'existing' WHEN action = 'matched-many' THEN 'shared' WHEN skip IS NOT NULL THEN 'skipped' WHEN status = 'cancelled' THEN 'not-created' WHEN eligibility <> 'include' THEN 'excluded' ELSE 'fresh' END AS route FROM r)"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    action = F.when(k % 5 == 0, "ambiguous").when(k % 5 == 1, "matched").when(k % 5 == 2, "matched-many").otherwise("unmatched")
    dates = F.when(k % 13 == 0, F.array().cast("array<date>")).otherwise(F.array(day))
    skip = reconcile.skip_reason(F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")), dates, "2000-01-01", LAST)
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled")
    eligibility = F.when(F.col("o_orderpriority") == "1-URGENT", "exclude").when(F.col("o_orderpriority") == "5-LOW", "uncertain").otherwise("include")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("day"), action.alias("action"), skip.alias("skip"), status.alias("status"), eligibility.alias("eligibility"))
    return rows.withColumn("route", reconcile.route(*map(F.col, ("action", "skip", "status", "eligibility"))))


@query(f"{ROUTED} SELECT o_orderkey, skip, route, max(CAST(route = 'ambiguous' AS INT)) OVER (PARTITION BY o_custkey) = 1 AS held FROM routed")
def reconcile_routes(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.held_groups(_routed(spark, sf), "o_custkey").select("o_orderkey", "skip", "route", "held")


@query(f"""{ROUTED} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN action = 'ambiguous' THEN 'ambiguous' WHEN o_orderkey % 17 = 0 THEN 'created' WHEN o_orderkey % 17 = 1 THEN 'updated' WHEN o_orderkey % 17 = 2 THEN 'unchanged' WHEN status = 'cancelled' THEN 'cancelled-not-created'
WHEN skip IS NOT NULL THEN 'structural-skip' WHEN eligibility = 'exclude' THEN 'excluded' WHEN eligibility = 'uncertain' THEN 'uncertain' ELSE 'structural-skip' END AS outcome FROM routed) GROUP BY outcome""")
def outcome_order(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 17
    change = F.when(k == 0, "created").when(k == 1, "updated").when(k == 2, "unchanged")
    out = reconcile.outcome(F.col("action"), change, *map(F.col, ("status", "skip", "eligibility")))
    return _routed(spark, sf).groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, o_custkey AS grp, min(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT c_nationkey, day, CASE WHEN count(DISTINCT m) > 1 THEN 'conflict' WHEN count(m) < count(*) THEN 'review' END AS kind FROM m GROUP BY ALL HAVING count(*) > 1)
SELECT grp AS o_custkey, min(kind) AS kind FROM m JOIN s USING (c_nationkey, day) WHERE kind IS NOT NULL GROUP BY grp""")
def slot_holds(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = o.select("o_custkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("m")).join(c, "o_custkey")
    return reconcile.slot_holds(rows, "o_custkey", ["c_nationkey", "day"], "m")


@query("""WITH r AS (SELECT DISTINCT event_id % 40 AS grp, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS clock FROM events WHERE event_type <> 'error'),
o AS (SELECT grp, day, max(n) AS most FROM (SELECT grp, day, user_id, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL)
SELECT grp, day, count(DISTINCT clock) AS clocks FROM r JOIN o USING (grp, day) GROUP BY grp, day, most HAVING count(DISTINCT clock) > 1 AND count(DISTINCT user_id) > 1 AND most < count(DISTINCT clock)""")
def cross_source_conflict(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type != 'error'").select((F.col("event_id") % 40).alias("grp"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("clock"))
    return reconcile.schedule_conflicts(e, "grp", "user_id", "day", "clock")


@query("""SELECT o_custkey, concat_ws(' ', CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'status' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'priority' END) AS fields FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def group_conflict(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return reconcile.group_conflict(o, "o_custkey", ["status", "priority"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS title, CASE WHEN l_quantity > 25 THEN [l_partkey] ELSE [] END AS works, CASE l_linestatus WHEN 'O' THEN 'unknown' ELSE 'paid' END AS access FROM lineitem)
SELECT l_orderkey, arg_max(title, (l_linenumber, l_partkey, l_suppkey)) FILTER (title <> '') AS title, array_to_string(arg_max(works, (l_linenumber, l_partkey, l_suppkey)) FILTER (len(works) > 0), ',') AS works,
coalesce(arg_max(access, (l_linenumber, l_partkey, l_suppkey)) FILTER (access <> 'unknown'), 'unknown') AS access FROM r GROUP BY l_orderkey""")
def proposal_fold(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("title"),
        F.when(F.col("l_quantity") > 25, F.array("l_partkey")).otherwise(F.array().cast("array<bigint>")).alias("works"), F.when(F.col("l_linestatus") == "O", "unknown").otherwise("paid").alias("access"),
    )
    out = reconcile.fold_proposals(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["title"], ["works"])
    return out.withColumn("works", F.array_join(F.col("works").cast("array<string>"), ","))


SESSIONS = """WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, CASE WHEN l_suppkey % 3 > 0 THEN lpad(CAST(10 + l_suppkey % 3 AS VARCHAR), 2, '0') || ':00' END AS clock, l_linestatus AS s FROM lineitem),
p AS (SELECT DISTINCT k, k || '-' || n AS ident, day, clock FROM (SELECT k, day, clock, min(n) AS n FROM li WHERE n <= 4 GROUP BY ALL)), n AS (SELECT DISTINCT k, day, clock FROM li WHERE n >= 3)"""


def _sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines up to the fourth as published sessions, those from the third as incoming ones; times are told for two of three."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), F.when(F.col("l_suppkey") % 3 > 0, F.concat((F.col("l_suppkey") % 3 + 10).cast("string"), F.lit(":00"))).alias("clock"))
    p = li.where("n <= 4").groupBy("k", "day", "clock").agg(F.min("n").alias("n")).select("k", F.concat_ws("-", "k", "n").alias("ident"), "day", "clock")
    return p, li.where("n >= 3").select("k", "day", "clock").distinct()


@query(f"""{SESSIONS}, pd AS (SELECT k, day, count(*) AS p_n, min(clock) AS p_clock FROM p GROUP BY ALL), nd AS (SELECT k, day, count(*) AS n_n, min(clock) AS n_clock FROM n GROUP BY ALL), out AS (
SELECT k, ident, day, clock, CASE WHEN n.k IS NULL THEN 'kept' ELSE 'exact' END AS change FROM p LEFT JOIN n USING (k, day, clock) WHERE clock IS NOT NULL
UNION ALL SELECT p.k, ident, p.day, CASE WHEN p_n = 1 AND n_n = 1 THEN n_clock END, CASE WHEN p_n = 1 AND n_n = 1 AND n_clock IS NOT NULL THEN 'refined' WHEN p_n = 1 AND n_n = 1 THEN 'exact' ELSE 'kept' END FROM p JOIN pd USING (k, day) LEFT JOIN nd USING (k, day) WHERE clock IS NULL
UNION ALL SELECT n.k, NULL, n.day, n.clock, 'new' FROM n LEFT JOIN pd USING (k, day) JOIN nd USING (k, day) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = n.k AND p.day = n.day AND p.clock = n.clock AND p.clock IS NOT NULL) AND NOT coalesce(p_n = 1 AND n_n = 1 AND (p_clock IS NULL OR n.clock IS NULL), false))
SELECT k, ident, strftime(day, '%Y-%m-%d') AS day, clock, change FROM out""")
def occurrence_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = reconcile.merge_occurrences(*_sessions(spark, sf), "k", "day", "clock", "ident", parts_for(table(spark, sf, "lineitem")))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH li AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, CAST(l_shipdate AS DATE) AS day FROM lineitem), p AS (SELECT k, k || '-' || min(n) || '-' || strftime(day, '%Y-%m-%d') AS ident, day FROM li WHERE n <= 4 GROUP BY k, day),
q AS (SELECT DISTINCT k, CASE WHEN n = 2 THEN day + 7 ELSE day END AS day FROM li WHERE n IN (2, 3, 5)), c AS (SELECT DISTINCT k, day AS f, day + 7 AS t FROM li WHERE n = 2), sc AS (SELECT DISTINCT k, DATE '2000-06-01' AS a, DATE '2001-03-31' AS b FROM li WHERE k % 2 = 0),
mv AS (SELECT c.k, c.f, c.t, p.ident, count(*) OVER (PARTITION BY c.k, c.f) > 1 OR count(*) OVER (PARTITION BY c.k, c.t) > 1 OR (SELECT count(*) FROM q WHERE q.k = c.k AND q.day = c.t) <> 1 AS odd FROM c JOIN p ON p.k = c.k AND p.day = c.f WHERE c.f >= DATE '1999-01-01'),
rv AS (SELECT DISTINCT k FROM mv WHERE odd), made AS (SELECT * FROM mv WHERE NOT odd),
st AS (SELECT p.k, p.ident, CASE WHEN rv.k IS NULL THEN coalesce(made.t, p.day) ELSE p.day END AS day, CASE WHEN rv.k IS NOT NULL THEN 'review' WHEN made.t IS NOT NULL THEN 'moved' WHEN q.k IS NOT NULL THEN 'kept' WHEN sc.k IS NOT NULL AND p.day >= DATE '1999-01-01' THEN 'dropped' ELSE 'kept' END AS action
FROM p LEFT JOIN rv USING (k) LEFT JOIN made ON made.k = p.k AND made.ident = p.ident LEFT JOIN q ON q.k = p.k AND q.day = p.day LEFT JOIN sc ON sc.k = p.k AND p.day BETWEEN sc.a AND sc.b),
fr AS (SELECT k, day FROM q WHERE (k, day) NOT IN (SELECT (k, day) FROM p UNION ALL SELECT (k, t) FROM made) AND k NOT IN (SELECT k FROM rv))
SELECT k, ident, strftime(day, '%Y-%m-%d') AS day, action FROM st UNION ALL SELECT k, NULL, strftime(day, '%Y-%m-%d'), 'new' FROM fr""")
def calendar_plan(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("day"))
    p = li.where("n <= 4").groupBy("k", "day").agg(F.min("n").alias("n")).select("k", F.concat_ws("-", "k", "n", F.date_format("day", "yyyy-MM-dd")).alias("ident"), "day")
    q = li.where("n in (2, 3, 5)").select("k", F.when(F.col("n") == 2, F.date_add("day", 7)).otherwise(F.col("day")).alias("day")).distinct()
    changes = li.where("n = 2").select("k", F.col("day").alias("from"), F.date_add("day", 7).alias("to"))
    scopes = li.where("k % 2 = 0").select("k", F.lit("2000-06-01").cast("date").alias("first"), F.lit("2001-03-31").cast("date").alias("last")).distinct()
    out = reconcile.calendar_plan(p, q, changes, scopes, "k", "ident", "day", "1999-01-01", parts_for(table(spark, sf, "lineitem")))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH c AS (SELECT o_orderkey, replace(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS name FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AND o_orderstatus <> 'F'), t AS (SELECT '2-high' AS name, 1 AS top UNION ALL SELECT '3-medium', 4)
SELECT o_orderkey, CASE WHEN place = 1 THEN name ELSE name || '-' || place END AS slug FROM (SELECT o_orderkey, c.name, coalesce(top, 0) + row_number() OVER (PARTITION BY c.name ORDER BY o_orderkey) AS place FROM c LEFT JOIN t USING (name))""")
def candidate_build(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus != 'F'").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    fresh = reconcile.publishable(o, "day", TODAY, LAST)
    taken = spark.createDataFrame([("2-high",), ("3-medium",), ("3-medium-4",)], "slug string")
    return reconcile.with_idents(fresh, text.slug("o_orderpriority"), taken, "slug", ["o_orderkey"]).select("o_orderkey", "slug")


@query("""WITH p AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 < 4 GROUP BY 1), c AS (SELECT o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1), w AS (SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1)
SELECT k AS o_orderkey, coalesce(p.n, 0) AS planned, coalesce(c.n, 0) AS candidates, coalesce(w.n, 0) AS written FROM p FULL JOIN c USING (k) FULL JOIN w USING (k) WHERE coalesce(p.n, 0) <> 1 OR coalesce(c.n, 0) <> 1 OR coalesce(w.n, 0) <> 1""")
def batch_integrity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    written = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus").distinct()
    return reconcile.integrity(o.where("o_orderkey % 5 < 4"), o.where("o_orderkey % 7 > 0"), written, "o_orderkey")


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS changes, count(*) FILTER (value > 200) AS deletes FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN errors > 20 OR deletes > 0 THEN 'abort' WHEN changes = 0 THEN 'no-op' WHEN errors > 10 THEN 'publish-draft' ELSE 'publish' END AS decision FROM u""")
def publication_decision(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("changes"), F.count_if(F.col("value") > 200).alias("deletes"))
    return u.select("user_id", reconcile.publication(F.col("errors") > 20, F.col("errors") > 10, F.col("changes"), F.col("deletes")).alias("decision"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS b, CAST(o_orderdate AS DATE) AS last_seen FROM orders) SELECT o_orderkey, a <> b AS material, a <> b OR DATE '2001-02-01' >= last_seen + 30 AS persisted FROM o""")
def material_diff(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("b"), F.to_date("o_orderdate").alias("last_seen"))
    seen = F.lit("2001-02-01").cast("date")
    return o.select("o_orderkey", (~F.col("a").eqNullSafe(F.col("b"))).alias("material"), reconcile.persisted({"status": F.col("b")}, {"status": F.col("a")}, seen, F.col("last_seen")).alias("persisted"))


@query("""WITH li AS (SELECT l_orderkey, l_linenumber AS n, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 3 AS VARCHAR) END AS t FROM lineitem),
a AS (SELECT l_orderkey, day, array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), ' ') AS x FROM li WHERE n <= 4 GROUP BY ALL), b AS (SELECT l_orderkey, day, array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), ' ') AS y FROM li WHERE n >= 4 GROUP BY ALL),
j AS (SELECT l_orderkey, day, a.l_orderkey IS NOT NULL AS ina, b.l_orderkey IS NOT NULL AS inb, coalesce(x, '') AS x, coalesce(y, '') AS y FROM (SELECT *, true AS here FROM a) a FULL JOIN b USING (l_orderkey, day))
SELECT l_orderkey, CASE WHEN NOT (ina AND inb) THEN 'dates' ELSE 'times' END AS kind, strftime(day, '%Y-%m-%d') AS day FROM (SELECT l_orderkey, day, EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = k.l_orderkey AND a.day = k.day) AS ina, EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = k.l_orderkey AND b.day = k.day) AS inb, x, y FROM j k) z
WHERE l_orderkey IN (SELECT l_orderkey FROM a) AND l_orderkey IN (SELECT l_orderkey FROM b) AND (NOT (ina AND inb) OR (x <> y AND x <> '' AND y <> ''))""")
def schedule_discrepancies(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), F.when(F.col("l_suppkey") % 2 == 0, (F.col("l_suppkey") % 3).cast("string")).alias("t"))
    return observe.discrepancies(li.where("n <= 4"), li.where("n >= 4"), "l_orderkey", "day", "t").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _blank(c: str, n: int) -> Column:
    return F.when(F.col("doc_id") % n == 0, F.lit("  ")).otherwise(F.col(c))


@query("""WITH r AS (SELECT doc_id, nullif(trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END, '\\s+', ' ', 'g')), '') AS title, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS programme FROM documents)
SELECT doc_id, title, md5(programme) AS programme, CASE WHEN title IS NULL THEN 'missing-title' WHEN doc_id % 5 = 0 THEN 'missing-date' WHEN doc_id % 11 = 0 THEN 'source-conflict' END AS discard FROM r""")
def normalise_observed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", _blank("source", 7).alias("title"), F.col("text").alias("programme"), F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("sessions"), (k % 11 == 0).alias("clash"))
    out = observe.normalise(d, "title", "sessions", [], "programme", "clash")
    return out.select("doc_id", "title", F.md5("programme").alias("programme"), "discard")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 6 <> 0 THEN upper(d.lang) ELSE d.source END AS title, CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 4 = 0 THEN d.lang ELSE d.source || ',' || d.lang END AS works FROM documents d""")
def observed_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents")
    listing = d.select("doc_id", F.col("source").alias("title"), F.array("source", "lang").alias("works"))
    detail = d.where(k % 3 == 0).select("doc_id", F.when(k % 6 == 0, F.lit(" ")).otherwise(F.upper("lang")).alias("title"), F.when(k % 4 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("works"))
    return observe.with_detail(listing, detail, "doc_id", ["title"], ["works"]).select("doc_id", "title", F.array_join("works", ",").alias("works"))


@query("""WITH t AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT p_brand) FILTER (l_returnflag = 'N')) AS stated, list_sort(list(DISTINCT p_brand) FILTER (l_linestatus = 'F')) AS told, list_sort(list(DISTINCT p_brand) FILTER (l_tax > 0.06)) AS titled, list(DISTINCT p_brand) FILTER (l_discount > 0.08) AS performing FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
u AS (SELECT k, list_filter(coalesce(stated, []), lambda x: NOT list_contains(coalesce(performing, []), x)) AS a, list_filter(coalesce(told, []), lambda x: NOT list_contains(coalesce(performing, []), x)) AS b, list_filter(coalesce(titled, []), lambda x: NOT list_contains(coalesce(performing, []), x)) AS c FROM t)
SELECT k, array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, ',') AS composers FROM u""")
def enriched_composers(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as composers: stated, attributed, in the title, performing, by what a line says."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    some = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("p_brand"))))
    sets = li.groupBy(F.col("l_orderkey").alias("k")).agg(some(F.col("l_returnflag") == "N").alias("a"), some(F.col("l_linestatus") == "F").alias("b"), some(F.col("l_tax") > 0.06).alias("c"), some(F.col("l_discount") > 0.08).alias("p"))
    return sets.select("k", F.array_join(observe.enriched(*map(F.col, "abcp")), ",").alias("composers"))


@query("""WITH c AS (SELECT doc_id % 50 AS event, source, lang AS url, n_chars % 28 AS checked FROM documents) SELECT event, source, url, max(checked) AS checked FROM c GROUP BY ALL""")
def citation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("event"), "source", F.col("lang").alias("url"), (F.col("n_chars") % 28).alias("checked"), "doc_id")
    return observe.upsert_citations(c.where("doc_id % 2 = 0").drop("doc_id"), c.where("doc_id % 2 = 1").drop("doc_id"), "event", "source", "url", "checked")


@query("""WITH r AS (SELECT c_custkey, n_nationkey AS own, n_regionkey + 100 AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT c_custkey, own, parent, CASE c_custkey % 4 WHEN 0 THEN parent WHEN 1 THEN own WHEN 2 THEN NULL ELSE (c_custkey // 4) % 25 END AS incoming FROM r),
y AS (SELECT x.*, CASE WHEN incoming < 100 THEN n_regionkey + 100 END AS iparent FROM x LEFT JOIN nation ON n_nationkey = incoming)
SELECT c_custkey, CASE WHEN incoming IS NULL THEN 'absent' WHEN incoming = own THEN 'same' WHEN iparent = own THEN 'refinement' WHEN parent = incoming THEN 'coarser' WHEN iparent = parent THEN 'sibling' ELSE 'unrelated' END AS relation, CASE WHEN incoming IS NULL OR (incoming <> own AND parent = incoming AND iparent IS DISTINCT FROM own) THEN own ELSE incoming END AS place FROM y""")
def venue_precision(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") + 100).alias("parent"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey").withColumnRenamed("n_nationkey", "own")
    k = F.col("c_custkey")
    incoming = F.when(k % 4 == 0, F.col("parent")).when(k % 4 == 1, F.col("own")).when(k % 4 == 3, F.floor(k / 4) % 25).cast("int")
    x = c.withColumn("incoming", incoming).join(n.select(F.col("n_nationkey").alias("incoming"), F.col("parent").alias("iparent")), "incoming", "left")
    relation = linkage.venue_relation(F.col("incoming"), F.col("iparent"), F.col("own"), F.col("parent"))
    return x.withColumn("relation", relation).select("c_custkey", "relation", reconcile.place_to_publish(F.col("own"), F.col("incoming"), F.col("relation")).alias("place"))


@query("""WITH RECURSIVE d AS (SELECT doc_id AS id, md5(text) AS t, source || '/' || (n_chars % 97) AS s, lang || '/' || n_chars AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT id, 't' || t AS key FROM d UNION SELECT id, 's' || s FROM d WHERE id % 3 = 0 UNION SELECT id, 'h' || h FROM d WHERE id % 4 = 0),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN (SELECT key, min(id) AS id FROM k GROUP BY key) b USING (key)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a""")
def fresh_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    k = F.col("doc_id")
    keys = F.array_compact(F.array(F.concat(F.lit("t"), F.md5("text")), F.when(k % 3 == 0, F.concat(F.lit("s"), "source", F.lit("/"), F.col("n_chars") % 97)), F.when(k % 4 == 0, F.concat(F.lit("h"), "lang", F.lit("/"), "n_chars"))))
    rows = d.select("doc_id", F.explode(keys).alias("key"))
    edges = rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("b")), "key").select(F.col("doc_id").alias("a"), "b")
    return d.select("doc_id").join(components(edges).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"))


@query("""WITH s AS (SELECT c_nationkey AS venue, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS event, count(*) AS n, min(o_orderpriority) AS p, max(o_orderpriority) AS q FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT o_orderkey, event, CASE WHEN n > 1 THEN 'ambiguous' WHEN p = o_orderpriority THEN 'match' ELSE 'conflict' END AS verdict FROM orders JOIN customer ON o_custkey = c_custkey JOIN s ON s.venue = c_nationkey AND s.day = CAST(o_orderdate AS DATE) WHERE o_orderkey % 2 = 1""")
def slot_match(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("venue"))
    rows = o.select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day")).join(c, "o_custkey")
    slots = rows.where("o_orderkey % 2 = 0").groupBy("venue", "day").agg(F.min("o_orderkey").alias("event"), F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p"))
    verdict = F.when(F.col("n") > 1, "ambiguous").when(F.col("p") == F.col("o_orderpriority"), "match").otherwise("conflict")
    return rows.where("o_orderkey % 2 = 1").join(slots, ["venue", "day"]).select("o_orderkey", "event", verdict.alias("verdict"))


@query("""SELECT o_orderkey, md5(array_to_string(list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m-%d'))), ',')) AS fingerprint FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY o_orderkey""")
def covered_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    li = reconcile.publishable(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("day")), "day", TODAY, LAST)
    return li.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").groupBy("o_orderkey").agg(accounting.fingerprint("day").alias("fingerprint"))
