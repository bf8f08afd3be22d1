"""Filters, names, civil times, texts and addresses, and smaller joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import civil, people, telling, text
from tessella.operators import accounting, agenda, classify, events, export, filters, linkage, observe, resolve
from tessella.sources.storage import table

from .registry import query

LABELS = {"access=free": "Gratis", "kind=established": "Salas"}
#: An address of each event, and what it must come to, from the event's columns: dates that are none for low values, a second value of a key, values that no key has.
TELLS = """SELECT event_id AS id, user_id, ts, CASE WHEN value >= 5 THEN strftime(ts, '%Y-%m-%d') END AS f, CASE WHEN event_type IN ('view', 'click') THEN 'jazz trio' END AS q, CASE event_type WHEN 'purchase' THEN 'established' WHEN 'view' THEN 'alternative' END AS kind,
CASE WHEN user_id < 50 THEN 'free' END AS access, CASE WHEN value > 20 THEN 'organ' END AS format, CASE WHEN event_type = 'signup' THEN 'early' END AS era FROM events"""
ORDER = ("q", "from", "access", "format", "era", "kind")
_C = {"from": "f"}
TOLD = "concat_ws('&', " + ", ".join(f"'{k}=' || replace({_C.get(k, k)}, ' ', '+')" for k in ORDER) + ")"
TOGGLED = TOLD.replace("replace(access,", "replace(CASE WHEN access IS NULL THEN 'free' END,")


def _query() -> Column:
    kind, v = F.col("event_type"), F.col("value")
    said = F.when(kind == "purchase", "established").when(kind == "view", "alternative").otherwise("bad")
    start = F.when(v >= 5, F.date_format("ts", "yyyy-MM-dd")).otherwise("2024-02-31")
    access = F.when(F.col("user_id") < 50, "&access=free&access=paid").when(F.col("user_id") < 100, "&access=bogus&access=free").otherwise("&access=%20free")
    return F.concat(F.lit("?kind="), said, F.lit("&from="), start, F.when(kind.isin("view", "click"), "&q=%20jazz+trio").otherwise("&q=%20"), F.lit("&x=1"), access, F.when(v > 20, "&format=organ").otherwise("&format=polka"), F.when(kind == "signup", "&era=early&era").otherwise("&era"))


@query(f"WITH t AS ({TELLS}) SELECT id AS event_id, {TOLD} AS told, CAST(" + " + ".join(f"CAST({_C.get(k, k)} IS NOT NULL AS INT)" for k in ORDER) + " AS INTEGER) AS active, true AS present FROM t")
def filter_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", _query().alias("query")).select("event_id", filters.present(F.col("query")).alias("present"), filters.parsed(F.col("query")).alias("f"))
    return e.select("event_id", filters.told(F.col("f")).alias("told"), filters.active(F.col("f")).alias("active"), "present")


def _change_sql(key: str, c: str) -> str:
    return f"CASE WHEN a.{c} IS NULL AND b.{c} IS NOT NULL THEN 'set:{key}' WHEN a.{c} IS NOT NULL AND b.{c} IS NULL THEN 'clear:{key}' WHEN a.{c} <> b.{c} THEN 'change:{key}' END"


@query(f"WITH t AS ({TELLS}), n AS (SELECT *, lead(id) OVER (PARTITION BY user_id ORDER BY ts, id) AS nx FROM t) SELECT a.id AS event_id, concat_ws(' ', " + ", ".join(_change_sql(k, _C.get(k, k)) for k in ORDER) + ") AS changes FROM n a JOIN t b ON b.id = a.nx")
def filter_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What each user's filters became in their next event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", filters.parsed(_query()).alias("f"))
    pairs = e.withColumn("g", F.lead("f").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("g is not null")
    return pairs.select("event_id", F.array_join(filters.changed(F.col("f"), F.col("g")), " ").alias("changes"))


@query(f"WITH t AS ({TELLS}) SELECT id AS event_id, concat_ws(', ', q, f, CASE access WHEN 'free' THEN 'Gratis' END, format, era, CASE kind WHEN 'established' THEN 'Salas' ELSE kind END) AS chips, {TOGGLED} AS toggled FROM t")
def filter_chips(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", filters.parsed(_query()).alias("f"))
    return e.select("event_id", F.array_join(filters.chips(F.col("f"), LABELS), ", ").alias("chips"), filters.told(filters.toggled(F.col("f"), "access", "free")).alias("toggled"))


@query(f"WITH t AS ({TELLS}) SELECT key, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {_C.get(k, k)} IS NOT NULL THEN '{k}' END" for k in ORDER) + "], lambda x: x IS NOT NULL)) AS key FROM t) GROUP BY key")
def filter_usage(spark: SparkSession, sf: str) -> DataFrame:
    return filters.usage(table(spark, sf, "events").select(filters.parsed(_query()).alias("f")), "f")


@query("SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS time, CASE WHEN CAST(ts + INTERVAL 1 HOUR AS DATE) >= DATE '2024-01-15' THEN CAST(date_diff('day', DATE '2024-01-15', CAST(ts + INTERVAL 1 HOUR AS DATE)) AS INTEGER) END AS days FROM events")
def civil_now(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    day = civil.today(ts)
    return table(spark, sf, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), civil.time_of_day(ts).alias("time"), civil.days_until(day, F.lit("2024-01-15").cast("date")).alias("days"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + INTERVAL '18 hours 30 minutes' AS local FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(day, '%Y-%m-%d') ELSE strftime(local, '%Y-%m-%dT%H:%M:%S') || '+0' || date_diff('hour', (local AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC', local) || ':00' END AS iso FROM o""")
def iso_datetimes(spark: SparkSession, sf: str) -> DataFrame:
    time = F.when(F.col("o_orderkey") % 3 != 0, "18:30")
    return table(spark, sf, "orders").select("o_orderkey", civil.iso(F.to_date("o_orderdate"), time).alias("iso"))


#: Words of roles, which the driver's texts have in four languages: a table of the user's own.
ROLES = {"conductor": ("the", "what"), "orchestra": ("les", "dans"), "choir": ("que", "los"), "ensemble": ("und", "der"), "singer": ("with",)}
WORDS = "string_split(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"SELECT conv_id, turn, CASE WHEN w = [''] THEN NULL " + " ".join(f"WHEN list_has_any(w, {list(v)}) THEN '{k}'" for k, v in ROLES.items()) + f" ELSE 'other' END AS role FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)")
def performer_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", people.role(F.col("text"), ROLES).alias("role"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'anon' WHEN 1 THEN 'years' WHEN 2 THEN 'loud' WHEN 3 THEN 'alias' ELSE 'twice' END AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS n FROM part)
SELECT p_partkey, CASE k WHEN 'years' THEN n WHEN 'loud' THEN n WHEN 'alias' THEN 'Johann Test' END AS composer FROM p""")
def composer_canonical(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.initcap(w)), " ")
    raw = F.when(k == 0, " Anónimo ").when(k == 1, F.concat(name, F.lit(" (1685-1750)"))).when(k == 2, F.upper(name)).when(k == 3, F.lit("J. Test (*1900)")).otherwise(F.lit("Twin"))
    aliases = spark.createDataFrame([("J Test", "Johann Test"), ("Twin", "Ann Twin"), ("twin", "Bob Twin")], "alias string, name string")
    return people.canonical(table(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", aliases, "alias", "name").select("p_partkey", "composer")


_TITLED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
SAID = f"""CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'Obras de ' || {_TITLED.format('p_name')} || ' y música de ' || {_TITLED.format('p_type')} WHEN 'ECONOMY' THEN 'un estreno compuesto por ' || {_TITLED.format('p_name')} || ', ' || p_name
WHEN 'STANDARD' THEN {_TITLED.format('p_name')} || ': trío' || chr(10) || {_TITLED.format('p_type')} || ' (18' || (10 + p_size) || '-1847)' ELSE p_name || ' ' || {_TITLED.format('p_brand')} END"""


@query("WITH t AS (SELECT p_partkey, " + SAID + " AS said FROM part) SELECT p_partkey, array_to_string(list_concat(" + ", ".join(f"list_transform(regexp_extract_all(said, '{pattern.replace(chr(39), chr(39) * 2)}', 1), lambda n: '{frame}:' || n)" for frame, pattern in people.FRAMES.items()) + "), ',') AS found FROM t")
def composer_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences made of a part's name and type, in the frame that goes with its type."""
    titled = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    said = F.when(first == "PROMO", F.concat(F.lit("Obras de "), titled("p_name"), F.lit(" y música de "), titled("p_type"))).when(first == "ECONOMY", F.concat(F.lit("un estreno compuesto por "), titled("p_name"), F.lit(", "), "p_name"))
    said = said.when(first == "STANDARD", F.concat(titled("p_name"), F.lit(": trío\n"), titled("p_type"), F.lit(" (18"), (F.col("p_size") + 10).cast("string"), F.lit("-1847)"))).otherwise(F.concat("p_name", F.lit(" "), titled("p_brand")))
    found = F.transform(people.attributions(said), lambda x: F.concat_ws(":", x["frame"], x["name"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("found"))


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, NOT regexp_matches(x, '\p{L}') OR regexp_matches(x, 'https?://|@|€|\b[0-9]{1,2}[:.][0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b') OR len(regexp_split_to_array(trim(x), '\s+')) > 12
OR regexp_matches(x, '(?i)^\s*(?:entradas?|tickets?|duración|programa|más información)\b') AS nobody FROM t""")
def performer_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", people.is_nobody(F.coalesce("text", F.lit(""))).alias("nobody"))


ONE_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, CASE WHEN length({ONE_LINE}) <= 160 THEN {ONE_LINE} ELSE regexp_replace(regexp_replace(left({ONE_LINE}, 159), '\s+\S*$', ''), '[\s,;:.–—-]+$', '') || '…' END AS snippet FROM documents")
def text_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", telling.compact(F.col("text")).alias("snippet"))


@query(rf"SELECT conv_id, turn, left(regexp_replace(regexp_replace(lower({ONE_LINE}), '\S+@\S+', '<mail>', 'g'), '\+?[0-9][0-9 ().-]{{7,}}[0-9]', '<number>', 'g'), 80) AS q FROM conversations")
def safe_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", telling.safe_query(F.col("text")).alias("q"))


LOGGED = """CASE event_type WHEN 'view' THEN 'GET /x?api_key=ab' || user_id || '&v=' || CAST(CAST(floor(value) AS INT) AS VARCHAR) WHEN 'purchase' THEN 'Authorization: Bearer ' || md5(props) WHEN 'signup' THEN 'password=' || user_id || 'x; token: ' || md5(props) ELSE event_type || ' with no more than ' || user_id || ' tokens' END"""


@query(f"SELECT event_id, regexp_replace({LOGGED}, '{telling.SECRETS.replace(chr(39), chr(39) * 2)}', '\\1***', 'g') AS line FROM events")
def redacted_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines made of an event's user, value and properties."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    line = F.when(kind == "view", F.concat(F.lit("GET /x?api_key=ab"), user, F.lit("&v="), F.floor("value").cast("int").cast("string"))).when(kind == "purchase", F.concat(F.lit("Authorization: Bearer "), F.md5("props")))
    line = line.when(kind == "signup", F.concat(F.lit("password="), user, F.lit("x; token: "), F.md5("props"))).otherwise(F.concat(kind, F.lit(" with no more than "), user, F.lit(" tokens")))
    return table(spark, sf, "events").select("event_id", telling.redacted(line).alias("line"))


@query("""SELECT doc_id, sha256('{' || CASE WHEN lang IS NULL THEN '' ELSE '"lang":"' || lang || '",' END || '"n_chars":' || n_chars || ',"source":"' || source || '"}') AS key FROM documents""")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", telling.stable_hash("source", "lang", "n_chars").alias("key"))


@query("SELECT o_orderkey, 'https://x.example/e/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '?a=1&' ELSE '?' END || 'utm_source=ics&utm_medium=calendar&utm_campaign=event' AS url FROM orders")
def campaign_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://X.example/e/"), k.cast("string"), F.when(k % 2 == 0, "/?a=1&utm_source=old#top").otherwise("?gclid=5"))
    return table(spark, sf, "orders").select("o_orderkey", telling.with_campaign(url, "ics", "calendar", "event").alias("url"))


@query("""SELECT page_id, CASE WHEN regexp_matches(path, '^/fr(/|$)') THEN 'french' WHEN regexp_matches(path, '/[0-9]+$') THEN 'detail' ELSE 'other' END AS kind FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", telling.page_kind(path, [("^/fr(/|$)", "french"), ("/[0-9]+$", "detail")]).alias("kind"))


@query("""WITH t AS (SELECT o_orderkey, coalesce(names, []) AS n FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT o_orderkey, array_to_string(n[1:3], ', ') || CASE WHEN len(n) > 3 THEN ' y ' || (len(n) - 3) || ' más' ELSE '' END AS facts FROM t""")
def fact_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's suppliers, told as a few names and how many more."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    names = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("names"))
    rows = table(spark, sf, "orders").join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", telling.facts(F.coalesce("names", F.array().cast("array<string>"))).alias("facts"))


@query("""SELECT o_orderkey, s_name AS series FROM orders LEFT JOIN supplier ON s_suppkey = CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_custkey // 12 END""")
def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders as events of a series, some of which aren't there: null where the user doesn't want that to raise."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.floor(F.col("o_custkey") / 12)).alias("key"))
    return resolve.one(o, "o_orderkey", "key", table(spark, sf, "supplier"), "s_suppkey", "told", strict=False).select("o_orderkey", F.col("told.s_name").alias("series"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT l_orderkey, arg_max(l_suppkey, (l_quantity, l_suppkey)) AS prim FROM lineitem GROUP BY 1) SELECT c.l_orderkey, s_name AS source, c.l_suppkey = p.prim AS is_primary FROM c JOIN p USING (l_orderkey) JOIN supplier ON s_suppkey = c.l_suppkey""")
def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as an order's sources; that of the largest line is its primary one."""
    li = table(spark, sf, "lineitem")
    events_ = li.groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("prim"))
    out = resolve.citations(li.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", events_, "prim", table(spark, sf, "supplier"), "s_suppkey")
    return out.select("l_orderkey", F.col("source_row.s_name").alias("source"), "is_primary")


@query("""WITH k AS (SELECT doc_id AS id, source || '/' || (doc_id % 200) AS ext, n_chars || lang AS al FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id, source || '/' || (doc_id % 200) AS ext, n_chars || lang AS al FROM documents WHERE doc_id % 2 = 1),
m AS (SELECT doc_id, 'external-id' AS method, count(DISTINCT id) AS n, min(id) AS first FROM o JOIN k USING (ext) GROUP BY doc_id UNION ALL SELECT doc_id, 'alias', count(DISTINCT id), min(id) FROM o JOIN k USING (al) GROUP BY doc_id) SELECT doc_id, method, n, first FROM m""".replace("'/' || (doc_id % 200) AS ext, n_chars || lang AS al FROM documents WHERE doc_id % 2 = 1", "'/' || ((doc_id + 1) % 200) AS ext, n_chars || lang AS al FROM documents WHERE doc_id % 2 = 1"))
def identity_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    ext = lambda n: F.concat("source", F.lit("/"), (n % 200).cast("string")).alias("ext")
    alias = F.concat(F.col("n_chars").cast("string"), "lang").alias("al")
    known = d.where(k % 2 == 0).select(k.alias("known"), ext(k), alias)
    return linkage.candidates(d.where(k % 2 == 1).select("doc_id", ext(k + 1), alias), known, {"external-id": ["ext"], "alias": ["al"]}, "doc_id", "known")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_name END AS place, CASE WHEN p_partkey % 3 = 0 THEN 'unknown' WHEN p_partkey % 3 = 1 THEN 'known' ELSE 'ambiguous' END AS verdict FROM part""")
def venue_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    p = table(spark, sf, "part")
    said = F.when(k == 0, "somewhere else").when(k == 1, F.concat(F.lit("At the "), "p_name", F.lit(", hall 2"))).otherwise(F.concat("p_name", F.lit(" and twin hall, or twin hall")))
    names = p.select(F.col("p_name").alias("name"), F.col("p_name").alias("place")).distinct()
    twins = spark.createDataFrame([("twin hall", "x"), ("twin hall", "y")], "name string, place string")
    return classify.place_of(p.select("p_partkey", said.alias("said")), "p_partkey", "said", names.union(twins), "name", "place").select("p_partkey", "place", "verdict")


@query("""WITH l AS (SELECT l_orderkey AS k, l_suppkey AS e, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_linenumber AS n FROM lineitem), o AS (SELECT DISTINCT k, day FROM l WHERE n <= 3), w AS (SELECT k, day, count(DISTINCT e) AS c, min(e) AS e FROM l WHERE n >= 2 GROUP BY ALL)
SELECT o.k, strftime(o.day, '%Y-%m-%d') AS day, CASE WHEN c = 1 THEN e END AS event, coalesce(c, 0) AS owners FROM o LEFT JOIN w USING (k, day)""")
def session_assignment(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("event"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), F.col("l_linenumber").alias("n"))
    out = linkage.assigned(li.where("n <= 3").select("k", "day").distinct(), li.where("n >= 2"), "k", "event", "day")
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "event", "owners")


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT '{"lang":"' || lang || '","size":' || CAST(n_chars // 5000 AS VARCHAR) || '}')), ';') AS evidence FROM documents GROUP BY source""")
def evidence_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "lang", F.floor(F.col("n_chars") / 5000).alias("size"))
    return linkage.distinct_evidence(d, "source", ["lang", "size"]).select("source", F.array_join("evidence", ";").alias("evidence"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, strftime(day, '%Y-%m-%d') AS day, EXISTS (SELECT 1 FROM s WHERE s.k = d.k AND d.day BETWEEN s.a AND s.b) AS covered FROM d""")
def scope_coverage(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    scopes = o.where("o_orderkey % 2 = 0").select("k", F.col("day").alias("a"), F.date_add("day", 60).alias("b")).distinct()
    out = linkage.covers(scopes, "k", "a", "b", o.where("o_orderkey % 2 = 1").select("k", "day").distinct(), "day")
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "covered")


@query("""WITH f AS (SELECT * FROM events WHERE event_type = 'error') SELECT a.event_id, a.user_id, count(DISTINCT b.event_id % 50) AS failing FROM f a JOIN f b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts GROUP BY ALL HAVING count(DISTINCT b.event_id % 50) >= 3""")
def host_circuit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("url", F.col("event_id") % 50)
    out = events.host_circuit(e, "user_id", "ts", "url", F.col("event_type") == "error", 3, 86_400)
    return out.select("event_id", "user_id", F.col("failing").cast("long").alias("failing"))


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS featured FROM part""")
def featured_and_rest(spark: SparkSession, sf: str) -> DataFrame:
    return agenda.featured(table(spark, sf, "part"), "p_brand", F.struct((-F.col("p_retailprice")).alias("price"), "p_partkey"), "p_partkey").select("p_brand", "p_partkey", "featured")


@query(r"""WITH t AS (SELECT source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, lang, n_chars FROM documents)
SELECT source, discard, count(*) AS n FROM (SELECT source, CASE WHEN x = '' THEN 'missing-title' WHEN n_chars < 150 THEN 'missing-date' WHEN n_chars > 6000 AND lang = 'en' THEN 'source-conflict' END AS discard FROM t) WHERE discard IS NOT NULL GROUP BY ALL""")
def discard_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts tell no session, long English ones contradict themselves."""
    d = table(spark, sf, "documents").withColumns({"sessions": F.when(F.col("n_chars") < 150, F.array()).otherwise(F.array("n_chars")), "odd": (F.col("n_chars") > 6000) & (F.col("lang") == "en")})
    return accounting.discards(observe.normalise(d, "text", "sessions", [], conflict="odd"), "source")


@query("""SELECT user_id AS source, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, max(value) AS slowest, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS failure_rate FROM events GROUP BY user_id""")
def http_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of their users, errors as failures, values as times."""
    return accounting.request_stats(table(spark, sf, "events").withColumnRenamed("user_id", "source"), "source", F.col("event_type") == "error", "value")


STATUS = {"O": "Programado", "F": "Cancelado"}
PLACES = "(SELECT c_custkey, n_name AS venue, r_name AS root FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("venue"), F.col("r_name").alias("root"))


SLUG = "replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ', '-')"


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'O' THEN 'Programado' WHEN 'F' THEN 'Cancelado' ELSE 'Otro' END AS status, {SLUG.format('root')} || CASE WHEN lower(root) <> lower(venue) THEN '/' || {SLUG.format('venue')} ELSE '' END AS place_key FROM orders JOIN {PLACES} ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01'")
def agenda_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'2000-06-01'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    rows = o.join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), agenda.labelled(F.col("o_orderstatus"), STATUS, "Otro").alias("status"), agenda.place_key(F.col("root"), F.col("venue")).alias("place_key"))


@query(f"SELECT o_orderkey FROM orders JOIN {PLACES} ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AND (root IN ('ASIA', 'EUROPE') OR o_orderkey % 10 = 0)")
def harvest_scope(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    area = F.when(F.col("o_orderkey") % 10 != 0, F.col("root"))
    return o.where(agenda.in_scope(F.to_date("o_orderdate"), area, "2001-01-01", "2001-06-30", ["ASIA", "EUROPE"])).select("o_orderkey")


@query("SELECT n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(lower(n_name), 'an')")
def venue_search(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.where(text.contains(F.col("n_name"), "1") | text.contains(F.col("n_name"), "ÁN")).select("n_name")


@query("""WITH s AS (SELECT l_orderkey AS k, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b, count(*) FILTER (CAST(l_shipdate AS DATE) < DATE '2000-01-01') AS past, count(*) FILTER (CAST(l_shipdate AS DATE) >= DATE '2000-01-01') AS to_come, min(CAST(l_shipdate AS DATE)) FILTER (CAST(l_shipdate AS DATE) >= DATE '2000-01-01') AS nx FROM lineitem GROUP BY 1)
SELECT o_orderkey, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last, strftime(nx, '%Y-%m-%d') AS next, coalesce(past, 0) AS past, coalesce(to_come, 0) AS to_come, coalesce(past, 0) > 0 AND coalesce(to_come, 0) = 0 AS is_past FROM orders LEFT JOIN s ON k = o_orderkey""")
def event_pages(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("day"))
    out = agenda.event_page(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", "day", "2000-01-01")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last", "next")})


@query("""WITH u AS (SELECT n_name, min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) >= DATE '2001-07-20') AS next FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name)
SELECT n_name, strftime(next, '%Y-%m-%d') AS next, row_number() OVER (ORDER BY next NULLS LAST, n_name) AS place FROM u""")
def venue_index_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'2001-07-20'").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    c, n = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, sf, "nation").select("n_nationkey", "n_name")
    first = o.join(c, "c_custkey").groupBy("n_nationkey").agg(F.min("day").alias("next"))
    return agenda.index_order(n.join(first, "n_nationkey", "left"), "n_name", "next").select("n_name", F.date_format("next", "yyyy-MM-dd").alias("next"), "place")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY CAST(l_shipdate AS DATE), CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_quantity > 25 THEN '20:00' ELSE '18:00' END END NULLS LAST, p_name, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS place
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def agenda_order(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions in order, by date, time (unknown last) and collated title."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.when(F.col("l_returnflag") != "N", F.when(F.col("l_quantity") > 25, "20:00").otherwise("18:00")).alias("time"))
    ident = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title")), "l_partkey").withColumn("ident", ident)
    return agenda.in_order(rows, "date", "time", "title", "ident").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query("SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY seen, p_brand) AS place FROM (SELECT l_orderkey, p_brand, min(l_linenumber) AS seen FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)")
def composer_order(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return agenda.appearance(li.join(p, "l_partkey"), "l_orderkey", "p_brand", "l_linenumber").select("l_orderkey", "p_brand", "place")


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-01-01' AND o_orderstatus = 'P' THEN lower(o_orderpriority) ELSE o_orderpriority END AS title FROM orders")
def past_is_immutable(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"))
    late = o.where("o_orderstatus = 'P'").withColumn("title", F.lower("title"))
    return agenda.only_future(o, late, "o_orderkey", "day", ["title"], "2000-01-01").select("o_orderkey", "title")


@query("""SELECT p_type, count(DISTINCT p_brand) AS composers, count(*) FILTER (p_brand IN ('Brand#1', 'Brand#2')) AS unresolved FROM part GROUP BY p_type""")
def composer_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    known = p.select("p_brand").distinct().where(~F.col("p_brand").isin("Brand#1", "Brand#2")).withColumn("known", F.lit(True))
    return p.join(known, "p_brand", "left").groupBy("p_type").agg(F.countDistinct("p_brand").alias("composers"), F.count_if(F.col("known").isNull()).alias("unresolved"))


@query("""SELECT o_orderpriority AS feed, strftime(max(o_orderdate), '%Y-%m-%d') AS lastmod, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2001-06-01' GROUP BY 1""")
def feed_lastmod(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities as feeds, orders up to a day as their entries."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("feed"), F.to_date("o_orderdate").alias("day"))
    return export.lastmod(o, "feed", "day", "2001-06-01").withColumn("lastmod", F.date_format("lastmod", "yyyy-MM-dd"))


@query(f"""WITH u AS (SELECT root, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders JOIN {PLACES} ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) >= DATE '2001-06-01' AND o_orderstatus <> 'F') SELECT root, o_orderkey, strftime(day, '%Y-%m-%d') AS day, place FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY day, o_orderkey) AS place FROM u) WHERE place <= 3""")
def article_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'2001-06-01' and o_orderstatus != 'F'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    rows = o.join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    out = agenda.latest(rows, "root", [F.asc("day"), F.asc("o_orderkey")], 3)
    return out.select("root", "o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("place").cast("long").alias("place"))
