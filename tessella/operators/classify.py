"""Rule and dictionary classification: ordered decisions over rule hits, access, dictionary spans, taxonomies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold, has_word, once

from . import scan

#: Taxonomies, in the order that results keep.
ERAS = ("early", "renaissance", "baroque", "classical", "romantic", "twentieth", "contemporary")
FORMATS = ("symphonic", "chamber", "recital", "choral", "organ", "early-music", "opera", "zarzuela", "lied", "other")
FREE = ("1", "true", "free", "gratis")
PAID = ("0", "false", "paid")
#: Word rules by kind, folded; a rule hits if one of its words is in the text.
EXCLUSIONS = {"dj-identity": ("dj", "discoteca"), "jazz-identity": ("jazz", "swing"), "flamenco-identity": ("flamenco", "cante"), "cinema-projection": ("cine", "film", "pelicula"), "popular-music-identity": ("pop", "rock", "rap")}
INCLUSIONS = {"opera-event": ("opera",), "zarzuela-event": ("zarzuela",), "organ-concert": ("organo", "organ", "orgel"), "classical-vocal-ensemble": ("coro", "choir", "chor", "choeur"), "explicit-classical-concert": ("sinfonia", "symphony", "cuarteto", "quartet", "sonata")}


#: More rules, in the order in which they are tried. What overrides excludes whatever else is told; a co-principal act shares the bill.
OVERRIDING = {"dance-spectacle": ("danza", "ballet", "dance"), "non-performance-activity": ("conferencia", "taller", "curso", "masterclass", "exposicion"), "participatory-activity": ("karaoke", "participativo"), "crossover-brand": ("candlelight", "tributo", "tribute")}
COPRINCIPAL = {"jazz-identity": EXCLUSIONS["jazz-identity"], "flamenco-identity": EXCLUSIONS["flamenco-identity"]}
HARD = {"dj-identity": EXCLUSIONS["dj-identity"], "cinema-projection": EXCLUSIONS["cinema-projection"], "film-music-identity": ("soundtrack", "bandas", "hollywood"), "popular-music-identity": EXCLUSIONS["popular-music-identity"]}
INCLUDING = {
    "known-classical-composer": (), "opera-event": ("opera", "operas"), "lyric-theatre-event": ("opereta", "singspiel"), "zarzuela-event": ("zarzuela", "zarzuelas"), "organ-concert": ("organo", "organ", "orgel"),
    "classical-vocal-ensemble": ("coro", "choir", "chor", "choeur", "orfeon"), "described-classical-repertoire": ("barroco", "renacentista", "romanticismo"), "academic-contemporary": ("estreno", "ensemble", "contemporaneo"),
    "explicit-classical-concert": ("sinfonia", "sinfonico", "symphony", "cuarteto", "quartet", "sonata", "camara"), "classical-concert-series": ("abono", "ciclo"),
}
#: Words that name a format, in the taxonomy's order.
FORMAT_WORDS = {
    "symphonic": ("sinfonia", "sinfonico", "sinfonica", "orquesta", "orchestra", "symphony"), "chamber": ("camara", "cuarteto", "trio", "quinteto", "quartet"), "recital": ("recital", "piano", "solista"),
    "choral": ("coro", "coral", "choir", "chor", "orfeon"), "organ": ("organo", "organ", "orgel"), "early-music": ("antigua", "renacentista", "consort", "medieval"), "opera": ("opera", "operas"), "zarzuela": ("zarzuela", "zarzuelas"), "lied": ("lied", "lieder", "canciones"),
}
#: Words between alternatives of which only one takes place.
ALTERNATIVES = ("alternativa", "sustituye", "oder", "bien")
CIRCUIT = ("auditorio", "teatro", "palacio", "conservatorio", "fundacion")
ALTERNATIVE_SPACES = ("bar", "sala", "cafe", "centro", "parque")
#: Words of a text that declare an era, and the era.
DECLARED = {"barroco": "baroque", "baroque": "baroque", "renacimiento": "renaissance", "renaissance": "renaissance", "clasicismo": "classical", "romanticismo": "romantic", "romantic": "romantic", "contemporaneo": "contemporary", "contemporanea": "contemporary"}


def words_of(text: Column) -> Column:
    """The distinct folded words of a text."""
    return F.array_distinct(F.split(fold(F.coalesce(text, F.lit(""))), " "))


def says(words: Column, any_of: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, any_of))) if any_of else F.lit(False)


def hits(words: Column, rules: Mapping[str, Sequence[str]], known: Mapping[str, Column] | None = None) -> Column:
    """The ids of all rules that hit, in their order; ``known``: conditions for rules that are no word lists."""
    known = known or {}
    return F.array_compact(F.array(*(F.when(known.get(name, F.lit(False)) | says(words, any_of), F.lit(name)) for name, any_of in rules.items())))


def first_rule(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first rule that hits, else null."""
    return once(words_of(text), lambda words: F.try_element_at(hits(words, rules), F.lit(1)))


def decide(overriding: Column, coprincipal: Column, hard: Column, inclusions: Column, substantial: Column, principal: Sequence[str] = ("film-music-identity", "popular-music-identity")) -> Column:
    """struct(value, rule_id) from the rule ids that hit (arrays) and whether a substantial classical block is told of; first hit wins."""

    def weighed(f: Column) -> Column:
        pair = lambda value, rule: F.struct(F.lit(value).alias("value"), rule.alias("rule_id"))
        head = lambda c: F.try_element_at(f[c], F.lit(1))
        some = lambda c: F.size(f[c]) > 0
        block = f["s"] & some("i")
        out = F.when(some("o"), pair("exclude", head("o"))).when(some("c") & block, pair("include", F.lit("mixed-program-classical-block")))
        out = out.when(some("c"), pair("uncertain", F.lit("classical-and-nonclassical-coprincipal")))
        both = some("h") & some("i")
        out = out.when(both & block, pair("include", F.lit("mixed-program-classical-block"))).when(both & head("h").isin(*principal), pair("exclude", head("h")))
        out = out.when(both, pair("uncertain", F.lit("classical-and-nonclassical-coprincipal"))).when(some("h"), pair("exclude", head("h")))
        return out.when(some("i"), pair("include", head("i"))).otherwise(pair("uncertain", F.lit("insufficient-evidence")))

    return once(F.struct(overriding.alias("o"), coprincipal.alias("c"), hard.alias("h"), inclusions.alias("i"), substantial.alias("s")), weighed)


def eligible(text: Column, composer_known: Column, substantial: Column) -> Column:
    """``decide`` over the rules of this module."""
    return once(
        F.struct(words_of(text).alias("w"), composer_known.alias("k"), substantial.alias("s")),
        lambda f: decide(hits(f["w"], OVERRIDING), hits(f["w"], COPRINCIPAL), hits(f["w"], HARD), hits(f["w"], INCLUDING, {"known-classical-composer": f["k"]}), f["s"]),
    )


def formats(title: Column, description: Column) -> Column:
    """struct(values, strength, rule_ids): formats of the title (strong), else of the description (weak); none if only one of several takes place."""

    def told(f: Column) -> Column:
        strong, weak = hits(f["t"], FORMAT_WORDS), hits(f["d"], FORMAT_WORDS)
        either = says(f["t"], ALTERNATIVES) | says(f["d"], ALTERNATIVES)
        none = F.array().cast("array<string>")
        out = lambda values, strength, rules: F.struct(values.alias("values"), F.lit(strength).alias("strength"), rules.alias("rule_ids"))
        rule = lambda values: F.transform(values, lambda v: F.concat(v, F.lit("-format")))
        found = F.when(F.size(strong) > 0, strong).otherwise(weak)
        return F.when(either & (F.size(found) > 1), out(none, "none", F.array(F.lit("formats-exclusive-alternatives")))).when(F.size(strong) > 0, out(strong, "strong", rule(strong))).when(
            F.size(weak) > 0, out(weak, "weak", rule(weak))
        ).otherwise(out(none, "none", F.array(F.lit("formats-insufficient"))))

    return once(F.struct(words_of(title).alias("t"), words_of(description).alias("d")), told)


def eras(works: Column, composers: Column, text: Column) -> Column:
    """struct(values, rule_id): eras of the works, else of the composers, else declared contemporary, else declared otherwise."""

    def told(f: Column) -> Column:
        out = lambda values, rule: F.struct(in_order(values).alias("values"), F.lit(rule).alias("rule_id"))
        declared = F.array_compact(F.array(*(F.when(F.array_contains(f["t"], word), F.lit(era)) for word, era in DECLARED.items())))
        contemporary = says(f["t"], [k for k, v in DECLARED.items() if v == "contemporary"])
        none = F.array().cast("array<string>")
        return F.when(F.size(f["w"]) > 0, out(f["w"], "eras-from-works")).when(F.size(f["c"]) > 0, out(f["c"], "eras-from-composers")).when(
            contemporary, out(F.array(F.lit("contemporary")), "eras-declared-contemporary")
        ).when(F.size(declared) > 0, out(declared, "eras-declared-programme")).otherwise(out(none, "eras-unknown"))

    empty = F.array().cast("array<string>")
    return once(F.struct(F.coalesce(works, empty).alias("w"), F.coalesce(composers, empty).alias("c"), words_of(text).alias("t")), told)


def kind(listed: Column, name: Column) -> Column:
    """struct(value, rule_id): from the list of known places, else from words of the place's name, else alternative."""
    pair = lambda value, rule: F.struct(F.lit(value).alias("value"), F.lit(rule).alias("rule_id"))

    def told(words: Column) -> Column:
        out = F.when(listed == "established", pair("established", "established-circuit")).when(listed == "alternative", pair("alternative", "alternative-space"))
        out = out.when(says(words, CIRCUIT), pair("established", "established-circuit")).when(says(words, ALTERNATIVE_SPACES), pair("alternative", "alternative-space"))
        return out.otherwise(pair("alternative", "kind-alternative-fallback"))

    return once(words_of(name), told)


def needs_review(eligibility: Column, strength: Column, access_rule: Column) -> Column:
    """Which fields a second look should settle: eligibility that is uncertain, formats that are weak or none, access that is unclear."""
    return F.array_compact(F.array(F.when(eligibility == "uncertain", "eligibility"), F.when((eligibility == "include") & (strength != "strong"), "formats"), F.when(access_rule == "access-unclear", "access")))


def eligibility(exclusion: Column, inclusion: Column, substantial: Column, principal: Sequence[str] = ("film-music-identity", "popular-music-identity")) -> Column:
    """struct(value, rule_id): exclusions and inclusions weighed in a fixed order."""

    def weighed(found: Column) -> Column:
        return _weighed(found["x"], found["i"], found["s"], principal)

    return once(F.struct(exclusion.alias("x"), inclusion.alias("i"), substantial.alias("s")), weighed)


def _weighed(exclusion: Column, inclusion: Column, substantial: Column, principal: Sequence[str]) -> Column:
    pair = lambda value, rule: F.struct(F.lit(value).alias("value"), rule.alias("rule_id"))
    both = exclusion.isNotNull() & inclusion.isNotNull()
    out = F.when(both & substantial, pair("include", F.lit("mixed-program-classical-block")))
    out = out.when(both & exclusion.isin(*principal), pair("exclude", exclusion)).when(both, pair("uncertain", F.lit("classical-and-nonclassical-coprincipal")))
    out = out.when(exclusion.isNotNull(), pair("exclude", exclusion)).when(inclusion.isNotNull(), pair("include", inclusion))
    return out.otherwise(pair("uncertain", F.lit("insufficient-evidence")))


def access(text: Column) -> Column:
    """struct(value, rule_id) from what a text says about entry."""
    return once(fold(F.coalesce(text, F.lit(""))), _access)


def _access(folded: Column) -> Column:
    pair = lambda value, rule: F.struct(F.lit(value).alias("value"), F.lit(rule).alias("rule_id"))
    free = folded.isin(*FREE) | has_word(folded, "(?:gratis|gratuit[oa]s?|free|kostenlos)") | folded.rlike("entrada libre|acceso libre|libre hasta completar aforo")
    paid = folded.isin(*PAID) | has_word(folded, "(?:precios?|tickets?|euros?|eur|entradas)")
    return F.when(folded == "", pair("unknown", "access-missing")).when(free, pair("free", "access-free")).when(paid, pair("paid", "access-paid")).otherwise(pair("unknown", "access-unclear"))


def in_order(values: Column, order: Sequence[str] = ERAS) -> Column:
    """The set of values, in the taxonomy's order."""
    return F.array_intersect(F.array(*map(F.lit, order)), values)


def spans(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, alias: str, name: str) -> DataFrame:
    """(id, name, start, n_words): dictionary names in folded texts, by joining word n-grams on whole aliases.

    Only n-grams as long as some alias are made. Texts are cut into words once.
    """
    keys = aliases.select(fold(F.col(alias)).alias("gram"), F.col(name).alias("name")).where("gram != ''").distinct()
    keys = keys.withColumn("n_words", F.size(F.split("gram", " ")))
    sizes = sorted(r[0] for r in keys.select("n_words").distinct().collect())  # one number a length
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, name string, start int, n_words int")
    heads = keys.select(F.split_part("gram", F.lit(" "), F.lit(1)).alias("first")).distinct()
    # a row of the start and its longest n-gram, so that no row has the whole text
    longest_gram = lambda w: F.transform(w, lambda x, i: F.struct(i.alias("start"), x.alias("first"), F.slice(w, i + 1, F.lit(max(sizes))).alias("w")))
    starts = docs.select(F.col(id_col).alias("id"), F.explode(once(F.split(fold(F.col(text_col)), " "), longest_gram)).alias("s")).select("id", "s.*")
    grams = F.explode(F.array(*(F.struct(F.lit(n).alias("n_words"), F.array_join(F.slice("w", 1, n), " ").alias("gram")) for n in sizes)))
    made = starts.join(heads, "first", "left_semi").select("id", "start", grams.alias("g")).select("id", "start", "g.*")
    return made.join(keys, ["n_words", "gram"]).select(F.col("id").alias(id_col), "name", "start", "n_words")


def composers_in(docs: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, alias: str, name: str, least: int = 4, guards: Sequence[str] = ()) -> DataFrame:
    """(id, name, start): composers that a text names, of overlapping names the longest. An alias of one word counts from ``least`` letters and
    if no other composer has it; right behind one of ``guards`` none counts. Composers are in order of their first mention by ``start``."""
    usable = dictionary.select(fold(F.col(alias)).alias("alias"), F.col(name).alias("name")).distinct()
    owners = usable.groupBy("alias").agg(F.count(F.lit(1)).alias("owners"))
    usable = usable.join(owners, "alias").where((F.col("owners") == 1) & ((F.length("alias") >= least) | F.contains("alias", F.lit(" "))))
    return scan.spans(docs, id_col, text_col, usable, "alias", "name", guards, longest_wins=True).groupBy(id_col, "name").agg(F.min("start").alias("start"))


def longest(found: DataFrame, id_col: str) -> DataFrame:
    """Of overlapping spans the longest wins, then the earliest, then the first name; the rest follow in that order."""
    return scan.longest(found, id_col)


def place_of(rows: DataFrame, id_col: str, text_col: str, places: DataFrame, name: str, place: str) -> DataFrame:
    """(id, place, verdict): the place that a text names - the longest known name in it; ambiguous if two are as long, unknown if none is."""
    found = spans(rows, id_col, text_col, places.select(F.col(name).alias("_alias"), F.col(place).cast("string").alias("_place")), "_alias", "_place")
    longest_n = F.max("n_words")
    best = found.join(found.groupBy(id_col).agg(longest_n.alias("n_words")), [id_col, "n_words"]).groupBy(id_col).agg(F.countDistinct("name").alias("n"), F.min("name").alias("place"))
    out = rows.select(id_col).distinct().join(best, id_col, "left")
    verdict = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("known")
    return out.select(id_col, F.when(F.col("n") == 1, F.col("place")).alias("place"), verdict.alias("verdict"))
