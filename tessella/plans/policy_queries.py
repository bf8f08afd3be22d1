"""Classification, validation codes, dates in prose, identifiers and addresses over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import idents, notices, urls
from tessella.operators import accounting, agenda, classify, export, quality
from tessella.sources.storage import dealt, parts_for, table

from .registry import query

WORDS = "list_distinct(string_split(trim(regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g')), ' '))"


def _hits_sql(words: str, rules: dict, known: dict | None = None) -> str:
    """The list of rules that hit, as SQL."""
    known = known or {}
    each = [f"CASE WHEN {' OR '.join(x for x in (known.get(k), f'list_has_any({words}, {list(v)})' if v else None) if x)} THEN '{k}' END" for k, v in rules.items()]
    return f"list_filter([{', '.join(each)}], lambda r: r IS NOT NULL)"


#: Fixture rules in the languages of the driver's texts, so that every branch is reached; operators take any rules.
OVERRIDING, COPRINCIPAL = {"dance-spectacle": ("danza", "worthless"), "crossover-brand": ("tributo", "garbage")}, {"jazz-identity": ("jazz", "pathetic"), "flamenco-identity": ("flamenco", "idiots")}
HARD = {"dj-identity": ("dj", "stupid"), "film-music-identity": ("soundtrack", "hateful"), "popular-music-identity": ("pop", "vile")}
INCLUDING = {"known-classical-composer": (), "opera-event": ("opera", "les"), "organ-concert": ("organo", "und"), "explicit-classical-concert": ("sinfonia", "que"), "classical-concert-series": ("abono", "with")}
TOLD = f"""WITH d AS (SELECT doc_id, source, lang, n_chars, {WORDS.format('text')} AS w FROM documents), h AS (SELECT *, {_hits_sql('w', OVERRIDING)} AS o, {_hits_sql('w', COPRINCIPAL)} AS c, {_hits_sql('w', HARD)} AS hd,
{_hits_sql('w', INCLUDING, {'known-classical-composer': "source = 'src3'"})} AS i, n_chars >= 2000 AS s FROM d)"""


@query(f"""{TOLD}, e AS (SELECT doc_id, CASE WHEN len(o) > 0 THEN ['exclude', o[1]] WHEN len(c) > 0 AND s AND len(i) > 0 THEN ['include', 'mixed-program-classical-block'] WHEN len(c) > 0 THEN ['uncertain', 'classical-and-nonclassical-coprincipal']
WHEN len(hd) > 0 AND len(i) > 0 AND s THEN ['include', 'mixed-program-classical-block'] WHEN len(hd) > 0 AND len(i) > 0 AND hd[1] IN ('film-music-identity', 'popular-music-identity') THEN ['exclude', hd[1]]
WHEN len(hd) > 0 AND len(i) > 0 THEN ['uncertain', 'classical-and-nonclassical-coprincipal'] WHEN len(hd) > 0 THEN ['exclude', hd[1]] WHEN len(i) > 0 THEN ['include', i[1]] ELSE ['uncertain', 'insufficient-evidence'] END AS v FROM h)
SELECT doc_id, v[1] AS value, v[2] AS rule_id FROM e""")
def eligibility_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", classify.words_of(F.col("text")).alias("w"))
    w = F.col("w")
    found = classify.decide(classify.hits(w, OVERRIDING), classify.hits(w, COPRINCIPAL), classify.hits(w, HARD), classify.hits(w, INCLUDING, {"known-classical-composer": F.col("source") == "src3"}), F.col("n_chars") >= 2000)
    return d.select("doc_id", found.alias("v")).select("doc_id", "v.*")


@query(f"""{TOLD} SELECT quality AS expected, CASE WHEN len(o) > 0 OR len(c) > 0 OR len(hd) > 0 THEN 'exclude' WHEN len(i) > 0 THEN 'include' ELSE 'uncertain' END AS actual, count(*) AS n FROM labels JOIN h USING (doc_id) GROUP BY ALL""")
def golden_confusion(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", classify.words_of(F.col("text")).alias("w"))
    w = F.col("w")
    none = F.array().cast("array<string>")
    against = F.concat(classify.hits(w, OVERRIDING), classify.hits(w, COPRINCIPAL), classify.hits(w, HARD))
    value = classify.decide(against, none, none, classify.hits(w, INCLUDING, {"known-classical-composer": F.col("source") == "src3"}), F.lit(False))
    rows = table(spark, sf, "labels").join(d.select("doc_id", value.alias("v")), "doc_id")
    return accounting.confusion(rows.select(F.col("quality").alias("expected"), F.col("v.value").alias("actual")), "expected", "actual")


@query(f"""WITH t AS (SELECT p_partkey, {WORDS.format('title')} AS t, {WORDS.format('descr')} AS d FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Sinfonía de ' || p_name WHEN 1 THEN 'Recital: coro y órgano' WHEN 2 THEN 'Ópera o bien zarzuela' ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 'música antigua, cuarteto' WHEN 1 THEN 'lieder' ELSE p_type END AS descr FROM part)),
h AS (SELECT p_partkey, {_hits_sql('t', classify.FORMAT_WORDS)} AS s, {_hits_sql('d', classify.FORMAT_WORDS)} AS k, list_has_any(t, {list(classify.ALTERNATIVES)}) OR list_has_any(d, {list(classify.ALTERNATIVES)}) AS either FROM t), f AS (SELECT *, CASE WHEN len(s) > 0 THEN s ELSE k END AS found FROM h)
SELECT p_partkey, CASE WHEN either AND len(found) > 1 THEN '' ELSE array_to_string(found, ',') END AS formats, CASE WHEN either AND len(found) > 1 THEN 'none' WHEN len(s) > 0 THEN 'strong' WHEN len(k) > 0 THEN 'weak' ELSE 'none' END AS strength,
CASE WHEN either AND len(found) > 1 THEN 'formats-exclusive-alternatives' WHEN len(found) > 0 THEN array_to_string(list_transform(found, lambda x: x || '-format'), ',') ELSE 'formats-insufficient' END AS rule_ids FROM f""")
def classify_formats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 6 == 0, F.concat(F.lit("Sinfonía de "), "p_name")).when(k % 6 == 1, "Recital: coro y órgano").when(k % 6 == 2, "Ópera o bien zarzuela").otherwise(F.col("p_name"))
    described = F.when(k % 4 == 0, "música antigua, cuarteto").when(k % 4 == 1, "lieder").otherwise(F.col("p_type"))
    rows = table(spark, sf, "part").select("p_partkey", classify.formats(title, described).alias("f"))
    return rows.select("p_partkey", F.array_join("f.values", ",").alias("formats"), "f.strength", F.array_join("f.rule_ids", ",").alias("rule_ids"))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['romantic', 'baroque'] ELSE [] END AS w, CASE WHEN doc_id % 4 = 0 THEN ['classical'] ELSE [] END AS c, {WORDS.format("CASE doc_id % 5 WHEN 1 THEN 'Estreno contemporáneo y barroco' WHEN 2 THEN 'Del Renacimiento al clasicismo' ELSE lang END")} AS t FROM documents),
e AS (SELECT doc_id, list_filter([CASE WHEN list_contains(t, 'renacimiento') OR list_contains(t, 'renaissance') THEN 'renaissance' END, CASE WHEN list_contains(t, 'barroco') OR list_contains(t, 'baroque') THEN 'baroque' END, CASE WHEN list_contains(t, 'clasicismo') THEN 'classical' END, CASE WHEN list_contains(t, 'romanticismo') OR list_contains(t, 'romantic') THEN 'romantic' END], lambda x: x IS NOT NULL) AS dc, w, c, list_has_any(t, ['contemporaneo', 'contemporanea']) AS k FROM d)
SELECT doc_id, CASE WHEN len(w) > 0 THEN 'baroque,romantic' WHEN len(c) > 0 THEN 'classical' WHEN k THEN 'contemporary' ELSE array_to_string(dc, ',') END AS eras, CASE WHEN len(w) > 0 THEN 'eras-from-works' WHEN len(c) > 0 THEN 'eras-from-composers' WHEN k THEN 'eras-declared-contemporary' WHEN len(dc) > 0 THEN 'eras-declared-programme' ELSE 'eras-unknown' END AS rule_id FROM e""")
def classify_eras(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    works, composers = F.when(k % 3 == 0, F.array(F.lit("romantic"), F.lit("baroque"))).otherwise(none), F.when(k % 4 == 0, F.array(F.lit("classical"))).otherwise(none)
    said = F.when(k % 5 == 1, "Estreno contemporáneo y barroco").when(k % 5 == 2, "Del Renacimiento al clasicismo").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", classify.eras(works, composers, said).alias("e")).select("doc_id", F.array_join("e.values", ",").alias("eras"), "e.rule_id")


@query(f"""WITH c AS (SELECT c_custkey, CASE c_nationkey WHEN 3 THEN 'established' WHEN 4 THEN 'alternative' END AS listed, {WORDS.format("CASE c_custkey % 3 WHEN 0 THEN 'Teatro Real' WHEN 1 THEN 'Café Central' ELSE c_name END")} AS w FROM customer), k AS (SELECT *, list_has_any(w, {list(classify.CIRCUIT)}) AS e, list_has_any(w, {list(classify.ALTERNATIVE_SPACES)}) AS a FROM c)
SELECT c_custkey, CASE WHEN listed IS NOT NULL THEN listed WHEN e THEN 'established' ELSE 'alternative' END AS value, CASE WHEN listed = 'established' OR (listed IS NULL AND e) THEN 'established-circuit' WHEN listed = 'alternative' OR a THEN 'alternative-space' ELSE 'kind-alternative-fallback' END AS rule_id FROM k""")
def classify_kind(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    listed = F.when(n == 3, "established").when(n == 4, "alternative")
    name = F.when(k % 3 == 0, "Teatro Real").when(k % 3 == 1, "Café Central").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", classify.kind(listed, name).alias("k")).select("c_custkey", "k.*")


@query(f"""{TOLD} SELECT doc_id, array_to_string(list_filter([CASE WHEN len(o) = 0 AND len(hd) = 0 AND len(i) = 0 THEN 'eligibility' END, CASE WHEN len(i) > 0 AND n_chars % 3 > 0 THEN 'formats' END, CASE WHEN n_chars % 5 = 0 THEN 'access' END], lambda x: x IS NOT NULL), ',') AS fields FROM h""")
def review_needs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", classify.words_of(F.col("text")).alias("w"))
    some = lambda rules, known=None: F.size(classify.hits(F.col("w"), rules, known)) > 0
    i = some(INCLUDING, {"known-classical-composer": F.col("source") == "src3"})
    value = F.when(i, "include").when(some(OVERRIDING) | some(HARD), "exclude").otherwise("uncertain")
    strength, access = F.when(F.col("n_chars") % 3 == 0, "strong").otherwise("weak"), F.when(F.col("n_chars") % 5 == 0, "access-unclear").otherwise("access-free")
    return d.select("doc_id", F.array_join(classify.needs_review(value, strength, access), ",").alias("fields"))


@query("""WITH names AS (SELECT DISTINCT p_name AS name, CASE WHEN p_name LIKE 'red%' THEN split_part(p_name, ' ', 2) ELSE p_name END AS alias FROM part), own AS (SELECT alias, min(name) AS name FROM names GROUP BY alias HAVING count(*) = 1 AND (length(alias) >= 5 OR contains(alias, ' '))),
t AS (SELECT p_partkey, string_split('the ' || p_name || ' with bolt and red gear', ' ') AS w FROM part), g AS (SELECT p_partkey, i, w[i] AS one, CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END AS two FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
m AS (SELECT p_partkey, i - 1 AS start, name, 1 AS n FROM g JOIN own ON alias = one UNION ALL SELECT p_partkey, i - 1, name, 2 FROM g JOIN own ON alias = two),
k AS (SELECT * FROM m a WHERE n = 2 OR NOT EXISTS (SELECT 1 FROM m b WHERE b.p_partkey = a.p_partkey AND b.n = 2 AND b.start <= a.start AND a.start < b.start + 2)) SELECT p_partkey, name, min(start) AS start FROM k GROUP BY ALL""")
def composer_scan(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    alias = F.when(F.startswith("p_name", F.lit("red")), F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name"))
    names = p.select(F.col("p_name").alias("name"), alias.alias("alias")).distinct()
    texts = p.select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(", with bolt and red gear.")).alias("text"))
    return classify.composers_in(texts, "p_partkey", "text", names, "alias", "name", least=5).select("p_partkey", "name", F.col("start").cast("long").alias("start"))


def _catalogue(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Events, sessions, citations and places with faults of every kind."""
    o, li, s, c = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier", "customer"))
    k = F.col("o_orderkey")
    events = o.select(
        k.alias("id"), F.col("o_custkey").alias("venue"), F.when(k % 3 == 0, (k % 40)).alias("series"), F.array((k % 130), (k % 90)).alias("organizers"), F.array(F.lit("baroque"), F.when(k % 50 == 0, "baroque").otherwise("romantic")).alias("eras"),
        F.when(k % 60 == 0, F.array(F.lit("opera"), F.lit("opera"))).otherwise(F.array(F.lit("opera"))).alias("formats"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("scheduled").alias("status"),
        (k % 100).alias("primary"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("verified"), F.col("o_orderpriority").alias("title"),
    )
    day = F.when(F.col("l_partkey") % 500 == 0, F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-31"))).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    sessions = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), day.alias("date"), F.when(F.col("l_linestatus") == "F", "cancelled").otherwise("scheduled").alias("session_status"), F.col("l_suppkey").alias("source"), F.date_format(F.date_sub("l_shipdate", 900), "yyyy-MM-dd").alias("checked"))
    places = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.floor(F.col("c_custkey") / 2).cast("long")).alias("parent"), F.when(F.col("c_custkey") % 8 == 0, "sala").alias("space"), F.when(F.col("c_acctbal") > 0, "calle").alias("address"))
    return {"events": events, "sessions": sessions, "places": places, "suppliers": s.select("s_suppkey")}


CATALOGUE = """WITH ev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 END AS series, [o_orderkey % 130, o_orderkey % 90] AS organizers, o_orderstatus = 'F' AS cancelled, o_orderkey % 100 AS prim, strftime(o_orderdate, '%Y-%m-%d') AS verified, o_orderpriority AS title FROM orders),
ss AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 500 = 0 THEN strftime(l_shipdate, '%Y-%m') || '-31' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date, l_linestatus = 'F' AS cancelled, l_suppkey AS source, strftime(CAST(l_shipdate AS DATE) - 900, '%Y-%m-%d') AS checked FROM lineitem),
pl AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 8 = 0 THEN 'sala' END AS space, CASE WHEN c_acctbal > 0 THEN 'calle' END AS address FROM customer),
issues AS (SELECT 'missing-series' AS code, 'error' AS severity, CAST(id AS VARCHAR) AS path FROM ev WHERE series NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 30)
UNION ALL SELECT 'missing-organizer', 'error', CAST(id AS VARCHAR) FROM (SELECT id, unnest(organizers) AS k FROM ev) WHERE k NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'duplicate-organizer-ref', 'error', CAST(id AS VARCHAR) FROM ev WHERE organizers[1] = organizers[2]
UNION ALL SELECT 'duplicate-era', 'warning', CAST(id AS VARCHAR) FROM ev WHERE id % 50 = 0 UNION ALL SELECT 'duplicate-format', 'warning', CAST(id AS VARCHAR) FROM ev WHERE id % 60 = 0
UNION ALL SELECT 'duplicate-occurrence-id', 'error', CAST(id AS VARCHAR) FROM ss GROUP BY id, n HAVING count(*) > 1 UNION ALL SELECT 'duplicate-occurrence', 'error', CAST(id AS VARCHAR) FROM ss GROUP BY id, date HAVING count(*) > 1
UNION ALL SELECT 'impossible-date', 'error', CAST(id AS VARCHAR) FROM ss WHERE try_cast(date AS DATE) IS NULL
UNION ALL SELECT 'cancelled-event-active-occurrence', 'error', CAST(id AS VARCHAR) FROM ev WHERE cancelled AND id IN (SELECT id FROM ss WHERE NOT cancelled)
UNION ALL SELECT 'missing-source', 'error', CAST(id AS VARCHAR) FROM ss WHERE source NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 500)
UNION ALL SELECT 'verification-date', 'error', CAST(ev.id AS VARCHAR) FROM ev JOIN (SELECT id, max(checked) AS latest FROM ss GROUP BY id) USING (id) WHERE latest > verified
UNION ALL SELECT 'primary-source', 'error', CAST(id AS VARCHAR) FROM ev WHERE NOT EXISTS (SELECT 1 FROM ss WHERE ss.id = ev.id AND ss.source = ev.prim)
UNION ALL SELECT 'venue-space-mismatch', 'error', CAST(id AS VARCHAR) FROM pl WHERE (parent IS NULL) <> (space IS NULL)
UNION ALL SELECT 'missing-venue-address', 'error', CAST(a.id AS VARCHAR) FROM pl a LEFT JOIN pl b ON a.parent = b.id WHERE coalesce(a.address, b.address) IS NULL
UNION ALL SELECT 'venue-parent-cycle', 'error', CAST(id AS VARCHAR) FROM pl WHERE id = 0
UNION ALL SELECT 'duplicate-id', 'error', CAST(source AS VARCHAR) FROM ss WHERE source % 10 = 0 GROUP BY source HAVING count(*) > 1
UNION ALL SELECT 'canonical-casing', 'error', CAST(id AS VARCHAR) FROM ev WHERE title <> upper(substr(title, 1, 1)) || lower(substr(title, 2))
UNION ALL SELECT 'area-mismatch', 'error', CAST(c_custkey AS VARCHAR) FROM customer WHERE (c_nationkey = 3) <> (c_mktsegment = 'BUILDING')
UNION ALL SELECT 'event-exists', 'error', CAST(id AS VARCHAR) FROM ev WHERE id % 1000 = 1 UNION ALL SELECT 'entity-conflict', 'error', CAST(id AS VARCHAR) FROM ev WHERE id % 1000 = 1 AND lower(title) <> title
UNION ALL SELECT 'duplicate-source-url', 'warning', CAST(id AS VARCHAR) FROM (SELECT id, prim, min(id) OVER (PARTITION BY prim, verified) AS first FROM ev) WHERE id <> first)"""


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    t = _catalogue(spark, sf)
    e, s, p, sup = t["events"], t["sessions"], t["places"], t["suppliers"]
    parts = parts_for(table(spark, sf, "lineitem"))
    own = dealt(s, parts, "id")  # what is asked of an event's sessions is grouped where they are
    rich = table(spark, sf, "supplier").where("s_acctbal > 500").select("s_suppkey")
    candidate = e.where("id % 1000 = 1").withColumn("title", F.lower("title"))
    title = F.concat(F.upper(F.substr("title", F.lit(1), F.lit(1))), F.lower(F.substr("title", F.lit(2))))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_nationkey") == 3) != (F.col("c_mktsegment") == "BUILDING")).alias("bad"))
    checks = [
        quality.dangling(e, "id", "series", sup.where("s_suppkey < 30"), "s_suppkey", "missing-series"), quality.bad_array_refs(e, "id", "organizers", sup, "s_suppkey", "missing-organizer"),
        quality.repeated_in_array(e, "id", "organizers", "duplicate-organizer-ref", "error"), quality.repeated_in_array(e, "id", "eras", "duplicate-era"), quality.repeated_in_array(e, "id", "formats", "duplicate-format"),
        quality.repeated(own, ["n"], "id", "duplicate-occurrence-id"), quality.repeated(own, ["date"], "id", "duplicate-occurrence"), quality.impossible_dates(s, "id", "date"),
        quality.cancelled_but_active(e, own, "id", "status", "session_status"), quality.dangling(s, "id", "source", rich, "s_suppkey", "missing-source"), quality.verified_before_checked(e, own, "id", "verified", "checked"),
        quality.primary_source(e, dealt(s, parts, "id", "source"), "id", "primary", "source"), quality.place_issues(p, "id", "parent", "space", "address"), quality.duplicate_keys(s.where("source % 10 = 0"), "id", F.col("source"), "duplicate-id"),
        quality.failing(e, "id", F.col("title") != title, "canonical-casing"), quality.failing(c, "id", F.col("bad"), "area-mismatch"), quality.already_there(e, candidate, "id"),
        quality.entity_conflicts(e, candidate, "id", ["title", "status"]), quality.later_duplicates(e, "id", F.concat_ws(" ", F.col("primary").cast("string"), F.col("verified")), "duplicate-source-url", "warning"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


@query(f"{CATALOGUE} SELECT code, severity, path FROM issues")
def validation_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf).select("code", "severity", "path")


@query(f"{CATALOGUE} SELECT code, severity, count(*) AS n, min(path) AS first, false AS passes FROM issues GROUP BY code, severity")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(_issues(spark, sf))


MONTH = "list_position(['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'], {})"
SAID = """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Aplazado al ' WHEN 1 THEN 'Concierto cancelado, iba a ser el ' WHEN 2 THEN 'El sábado ' ELSE '' END || day(o_orderdate) || ' de ' || (['enero', 'febrero', 'Marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'])[month(o_orderdate)]
|| CASE o_orderkey % 4 WHEN 0 THEN '' ELSE ' de ' || year(o_orderdate) END || CASE o_orderkey % 3 WHEN 0 THEN ', a las 19.30 h' WHEN 1 THEN ' 9:05' ELSE '' END AS said, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 = 0 AS bare FROM orders)"""


def _said() -> Column:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    opening = F.when(k % 6 == 0, "Aplazado al ").when(k % 6 == 1, "Concierto cancelado, iba a ser el ").when(k % 6 == 2, "El sábado ").otherwise("")
    month = F.element_at(F.array(*(F.lit(m if m != "marzo" else "Marzo") for m in notices.MONTHS)), F.month(d))
    year = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" de "), F.year(d).cast("string")))
    return F.concat(opening, F.dayofmonth(d).cast("string"), F.lit(" de "), month, year, F.when(k % 3 == 0, ", a las 19.30 h").when(k % 3 == 1, " 9:05").otherwise(""))


@query(SAID + " SELECT k AS o_orderkey, CASE WHEN NOT bare THEN strftime(day, '%Y-%m-%d') END AS date, CASE k % 3 WHEN 0 THEN '19:30' WHEN 1 THEN '09:05' END AS time, CASE k % 6 WHEN 0 THEN 'postponed' WHEN 1 THEN 'cancelled' ELSE 'scheduled' END AS status, CASE WHEN k % 6 = 0 AND NOT bare THEN strftime(day, '%Y-%m-%d') END AS moved_to FROM t")
def spanish_notices(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select("o_orderkey", _said().alias("said"))
    n = t.select("o_orderkey", notices.spanish_date(F.col("said")).alias("date"), notices.clock(F.col("said")).alias("time"), notices.notice(F.col("said")).alias("n"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return n.select("o_orderkey", text("date").alias("date"), "time", "n.status", text("n.date").alias("moved_to"))


@query("""WITH t AS (SELECT event_id, ts, event_type AS e, value > 35 AS sec FROM events)
SELECT event_id, CASE e WHEN 'view' THEN strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') WHEN 'purchase' THEN strftime(ts - INTERVAL 4 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%d') WHEN 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date,
CASE e WHEN 'view' THEN strftime(ts + INTERVAL 1 HOUR, '%H:%M') WHEN 'click' THEN strftime(ts, '%H:%M') WHEN 'purchase' THEN strftime(ts - INTERVAL 4 HOUR - INTERVAL 30 MINUTE, '%H:%M') END AS time FROM t""")
def observed_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times as feeds write them, by the kind of event: instants, naive times, bare dates and impossible ones, with seconds where the value is high."""
    e, ts = F.col("event_type"), F.col("ts")
    with_seconds = lambda long, short: F.when(F.col("value") > 35, F.date_format(ts, long)).otherwise(F.date_format(ts, short))
    said = F.when(e == "view", with_seconds("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm'Z'")).when(e == "click", with_seconds("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"))
    said = said.when(e == "signup", F.date_format(ts, "yyyy-MM-dd")).when(e == "purchase", with_seconds("yyyy-MM-dd'T'HH:mm:ss'.123+05:30'", "yyyy-MM-dd'T'HH:mm'+0530'"))
    said = said.otherwise(with_seconds("yyyy-MM-dd'T99:'mm", "yyyy-MM-dd'garbage'"))
    rows = table(spark, sf, "events").select("event_id", notices.observed(said).alias("o"))
    return rows.select("event_id", F.date_format("o.date", "yyyy-MM-dd").alias("date"), "o.time")


@query(f"""SELECT day, (['lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado', 'domingo'])[isodow(day)] || ', ' || day(day) || ' de ' || ({list(notices.MONTHS)})[month(day)] || ' de ' || year(day) AS said FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day0, CAST(o_orderdate AS DATE) AS day FROM orders)""".replace("SELECT day, (", "SELECT day0 AS day, ("))
def long_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), notices.long_date(F.col("d")).alias("said"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS place, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, place, 'evt_' || replace(p_name, ' ', '_') || '_' || l_orderkey AS event_id, 'occ_' || replace(p_name, ' ', '_') || '_' || l_orderkey || '_' || CASE WHEN place < 10 THEN '0' ELSE '' END || place AS occurrence_id FROM o""")
def minted_ids(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    rows = li.withColumn("place", F.row_number().over(order).cast("long")).join(p, "l_partkey")
    event = idents.event_id(F.concat_ws(" ", "p_name", F.col("l_orderkey").cast("string")))
    return rows.select("l_orderkey", "place", event.alias("event_id"), idents.occurrence_id(event, F.col("place")).alias("occurrence_id"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'RTVE ' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || ' II' ELSE p_name END AS title FROM part""")
def quiet_titles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    loud = F.when(k % 2 == 0, F.concat(F.when(k % 4 == 0, "RTVE ").otherwise(""), F.upper("p_name"), F.lit(" II."))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", idents.quiet(loud).alias("title"))


_NORMAL = "CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract({0}, '^[^:]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract({0}, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract({0}, '^[^:#?]*://[^?#]*([?][^#]*)', 1) ELSE {0} END"


@query(f"""WITH u AS (SELECT page_id, url, lead(url) OVER (PARTITION BY regexp_extract(url, '^[^:]*://([^/?#]*)', 1) ORDER BY regexp_extract(url, '[?&]page=([^&#]*)', 1), page_id) AS near, replace(upper(regexp_extract(url, '^[^:]*://[^/?#]*', 0)), 'HTTPS', 'https') || regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1), '/$', '') || '#x' AS other FROM pages)
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS cms_id, {_NORMAL.format('url')} = {_NORMAL.format('other')} AS same, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') = nullif(regexp_extract(near, '[?&]page=([^&#]*)', 1), ''), false) OR {_NORMAL.format('url')} = {_NORMAL.format('near')} AS near_same FROM u""")
def url_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's address beside itself in other spelling and beside the next of its host; a page number is a content id here."""
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    near = F.lead("url").over(Window.partitionBy(host).orderBy(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), "page_id"))
    other = F.concat(F.replace(F.upper(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)), F.lit("HTTPS"), F.lit("https")), F.regexp_replace(F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1), "/$", ""), F.lit("#x"))
    rows = table(spark, sf, "pages").select("page_id", "url", near.alias("near"), other.alias("other"))
    same = urls.equivalent(F.col("url"), F.col("other"))
    return rows.select("page_id", urls.parameter(F.col("url"), "page").alias("cms_id"), same.alias("same"), urls.equivalent(F.col("url"), F.col("near"), "page").alias("near_same"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, rank() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderpriority, o_orderkey) AS place FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-06-01'""")
def agenda_sort(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day")).where("day >= '2001-06-01'")
    out = agenda.placed(o, "day", ["o_orderpriority", "o_orderkey"])
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "place")


@query("""SELECT c_custkey, 'd' || c_custkey AS slug, c_custkey AS canonical, false AS redirect FROM customer UNION ALL SELECT c_custkey, 'old-' || c_custkey, c_custkey, true FROM customer WHERE c_custkey % 3 = 0""")
def slug_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("d"), k).alias("slug"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("old-"), k))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return agenda.slugs(c, "c_custkey", "slug", "aliases").select("c_custkey", "slug", F.col("c_custkey").alias("canonical"), "redirect")


@query("""SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || '@tessella' || chr(13) || chr(10) || 'DTSTART:' || strftime(o_orderdate, '%Y%m%d') || 'T180000Z' || chr(13) || chr(10) || 'SUMMARY:' || replace(o_orderpriority, ',', '\\,') || chr(13) || chr(10) || 'END:VEVENT' AS lines FROM orders WHERE month(o_orderdate) IN (12, 1, 2)""")
def ics_timed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where(F.month("o_orderdate").isin(12, 1, 2))
    lines = export.timed_event(F.concat(F.col("o_orderkey").cast("string"), F.lit("@tessella")), F.to_date("o_orderdate"), F.lit("19:00"), F.col("o_orderpriority"))
    return o.select("o_orderkey", lines.alias("lines"))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, CAST(ceil(strlen(line) / 75.0) AS BIGINT)), lambda i: substr(line, CAST(i * 75 + 1 AS BIGINT), 75)), chr(13) || chr(10) || ' ') AS folded FROM (SELECT doc_id, 'DESCRIPTION:' || repeat(lang || source, 30) AS line FROM documents)""".replace("i * 75 + 1 AS BIGINT), 75)", "CASE WHEN i = 0 THEN 1 ELSE i * 74 + 2 END AS BIGINT), CASE WHEN i = 0 THEN 75 ELSE 74 END)").replace("ceil(strlen(line) / 75.0)", "1 + ceil(greatest(strlen(line) - 75, 0) / 74.0)"))
def ics_folding(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("DESCRIPTION:"), F.repeat(F.concat("lang", "source"), F.lit(30)))
    return table(spark, sf, "documents").select("doc_id", export.folded(line).alias("folded"))


@query("""SELECT o_orderkey, '{"@context":"https://schema.org","@type":"MusicEvent","name":"' || o_orderpriority || '","startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","eventStatus":"https://schema.org/' || CASE o_orderstatus WHEN 'F' THEN 'EventCancelled' WHEN 'P' THEN 'EventPostponed' ELSE 'EventScheduled' END || '","location":{"@type":"Place","name":"' || c_name || '"}}' AS json FROM orders JOIN customer ON o_custkey = c_custkey""")
def json_ld_events(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled")
    return o.join(c, "o_custkey").select("o_orderkey", export.event_json(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), status, F.col("c_name")).alias("json"))


@query("""SELECT DISTINCT '<url><loc>https://tessella.example/' || regexp_replace(url, '^https?://[^/]+/', '') || '</loc></url>' AS entry FROM (SELECT DISTINCT replace(url, '&', '&amp;') AS url FROM pages)""")
def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]+/", "")
    return export.sitemap(table(spark, sf, "pages").select(path.alias("path")).distinct(), "https://tessella.example/", "path")
