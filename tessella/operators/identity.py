"""Whether two records tell of one event: names, works, music, titles, sources, slots.

Facts are Columns: arrays of folded names, arrays of struct(title, composer), titles. Every verdict is an
ordered CASE, so a pair is judged in one pass; absence of a fact never speaks against a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import fold, once

#: Words that open a title and say what kind of event it is, not which.
ACTIVITIES = ("concierto", "concert", "recital", "ciclo", "gala", "festival", "audicion", "clausura", "inauguracion")
#: Titles that name a form and so need a composer to tell works apart.
GENERIC = ("sinfonia", "sonata", "cuarteto", "concierto", "trio", "quinteto", "suite", "misa", "requiem", "preludio", "lieder", "canciones")
CATALOGUE = r"\b(?:op|bwv|kv?|hob|d|rv|hwv|woo)\s*[0-9]+[a-z]?\b"


def _bare(folded: Column) -> Column:
    return F.replace(folded, F.lit(" "))


def names_agree(a: Column, b: Column) -> Column:
    """Two folded names of people or ensembles: equal, equal without spaces, one inside the other if that is long enough, or one
    surname with given names that are equal or one the other's initial. Not transitive."""

    def judged(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
        long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
        inside = F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" "))) & ((F.length(short) >= 10) | F.contains(short, F.lit(" ")))
        surname = lambda z: F.element_at(F.split(z, " "), -1)
        given = lambda z: F.element_at(F.split(z, " "), 1)
        many = F.contains(x, F.lit(" ")) & F.contains(y, F.lit(" "))
        initial = (given(x) == given(y)) | (F.length(given(x)) == 1) & F.startswith(given(y), given(x)) | (F.length(given(y)) == 1) & F.startswith(given(x), given(y))
        people = many & (surname(x) == surname(y)) & (F.length(surname(x)) >= 4) & initial
        return (x != "") & (y != "") & ((x == y) | (_bare(x) == _bare(y)) | inside | people)

    return once(F.struct(a.alias("a"), b.alias("b")), judged)


def any_agree(left: Column, right: Column, agree: Callable[[Column, Column], Column] = names_agree) -> Column:
    return F.exists(left, lambda x: F.exists(right, lambda y: agree(x, y)))


def catalogue_numbers(title: Column) -> Column:
    """The catalogue numbers of a folded title, without spaces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(CATALOGUE), 0), _bare))


def work_core(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, CATALOGUE, " "), r"\s+", " "))


def works_agree(a: Column, b: Column) -> Column:
    """Two struct(title, composer), folded: other composers, no; a shared catalogue number, yes; numbers on both sides and none
    shared, no; equal cores, if they are more than a form or the composers agree; one core in the other from 12 characters."""

    def judged(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        known = (F.coalesce(x["composer"], F.lit("")) != "") & (F.coalesce(y["composer"], F.lit("")) != "")
        composers = known & names_agree(F.coalesce(x["composer"], F.lit("")), F.coalesce(y["composer"], F.lit("")))
        m, n = catalogue_numbers(x["title"]), catalogue_numbers(y["title"])
        p, q = work_core(x["title"]), work_core(y["title"])
        inside = (F.least(F.length(p), F.length(q)) >= 12) & (F.contains(p, q) | F.contains(q, p))
        out = F.when(known & ~composers, False).when(F.arrays_overlap(m, n), True).when((F.size(m) > 0) & (F.size(n) > 0), False)
        return out.when((p == q) & (p != ""), ~p.isin(*GENERIC) | composers).otherwise(inside)

    return once(F.struct(a.alias("a"), b.alias("b")), judged)


def title_core(title: Column) -> Column:
    """The folded title without the word that opens it with a kind of event, and what it is followed by."""
    return F.trim(F.regexp_replace(fold(title), rf"^(?:(?:{'|'.join(ACTIVITIES)})(?: (?:de|del|of|extraordinario))?(?: |$))+", ""))


def titles_agree(a: Column, b: Column) -> Column:
    """Equal cores that are more than a form of work."""

    def judged(pair: Column) -> Column:
        return (pair["a"] == pair["b"]) & (F.length(pair["a"]) >= 4) & ~pair["a"].isin(*GENERIC, *ACTIVITIES)

    return once(F.struct(title_core(a).alias("a"), title_core(b).alias("b")), judged)


def shared_phrase(a: Column, b: Column, words: int = 2) -> Column:
    """Some run of so many words is in both folded titles."""
    grams = lambda t: F.when(F.size(F.split(t, " ")) >= words, F.transform(F.sequence(F.lit(1), F.size(F.split(t, " ")) - words + 1), lambda i: F.array_join(F.slice(F.split(t, " "), i, words), " "))).otherwise(F.array().cast("array<string>"))
    return F.arrays_overlap(grams(a), grams(b))


def _grams(title: Column, words: int = 2) -> Column:
    """The runs of so many words of a folded title."""
    return once(F.split(title, " "), lambda t: F.when(F.size(t) >= words, F.transform(F.sequence(F.lit(1), F.size(t) - words + 1), lambda i: F.array_join(F.slice(t, i, words), " "))).otherwise(F.array().cast("array<string>")))


def _name_keys(names: Column) -> Column:
    """What names_agree asks of folded names, as sets: ``equal`` is shared by names that are equal, equal without spaces, or people with one surname and equal given
    names; an ``initial`` of one side meets a ``given`` of the other; ``short`` ones may stand inside the names of ``long``."""
    named = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != "")
    surname = lambda x: F.substring_index(x, " ", -1)
    given = lambda x: F.substring_index(x, " ", 1)
    of = lambda people, tag, first: F.transform(people, lambda x: F.concat(F.lit(tag), first(x), F.lit(" "), surname(x)))
    people = F.filter(named, lambda x: F.contains(x, F.lit(" ")) & (F.length(surname(x)) >= 4))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return once(F.struct(named.alias("n"), people.alias("p")), lambda v: F.struct(
        F.array_union(F.transform(v["n"], _bare), of(v["p"], "p:", given)).alias("equal"),
        F.array_distinct(of(F.filter(v["p"], lambda x: F.length(given(x)) == 1), "", given)).alias("initial"),
        F.array_distinct(of(F.filter(v["p"], lambda x: F.length(given(x)) >= 1), "", lambda x: F.left(given(x), F.lit(1)))).alias("given"),
        F.transform(F.filter(v["n"], lambda x: (F.length(x) >= 10) | F.contains(x, F.lit(" "))), padded).alias("short"), F.array_join(F.transform(v["n"], padded), "\n").alias("long"),
    ))


def _keys_agree(a: Column, b: Column) -> Column:
    """Some name of one side agrees with one of the other, from their keys."""
    inside = lambda x, y: F.exists(x["short"], lambda s: F.contains(y["long"], s))
    return F.arrays_overlap(a["equal"], b["equal"]) | F.arrays_overlap(a["initial"], b["given"]) | F.arrays_overlap(a["given"], b["initial"]) | inside(a, b) | inside(b, a)


def _prepared_works_agree(x: Column, y: Column) -> Column:
    """works_agree of two prepared works; what tells of titles is asked first, as it is cheap and mostly says no."""
    composers = x["known"] & y["known"] & _keys_agree(x["names"], y["names"])
    unlike = x["known"] & y["known"] & ~_keys_agree(x["names"], y["names"])
    p, q = x["core"], y["core"]
    same = F.arrays_overlap(x["numbers"], y["numbers"])
    unnumbered = (F.size(x["numbers"]) == 0) | (F.size(y["numbers"]) == 0)
    equal = (p == q) & (p != "")
    inside = (F.length(p) >= 12) & (F.length(q) >= 12) & (F.contains(p, q) | F.contains(q, p))
    return (same & ~unlike) | (unnumbered & F.when(equal, F.when(p.isin(*GENERIC), composers).otherwise(~unlike)).otherwise(inside & ~unlike))


def prepared(side: Mapping[str, Column], titles: bool = True) -> Column:
    """What musical verdicts ask of performers, works, composers (arrays, folded) and title (folded) of one side, worked out once for all its pairs;
    without ``titles``, what verdicts without titles ask of performers and works."""
    composer = lambda w: F.coalesce(w["composer"], F.lit(""))
    works = F.transform(side["works"], lambda w: F.struct(
        catalogue_numbers(w["title"]).alias("numbers"), work_core(w["title"]).alias("core"), (composer(w) != "").alias("known"), _name_keys(F.array(composer(w))).alias("names"),
    ))
    music = [(F.size(side["performers"]) > 0).alias("some_performers"), (F.size(side["works"]) > 0).alias("some_works"), _name_keys(side["performers"]).alias("performers"), works.alias("works")]
    if not titles:
        return F.struct(*music)
    core = once(title_core(side["title"]), lambda t: F.when((F.length(t) >= 4) & ~t.isin(*GENERIC, *ACTIVITIES), t))
    return F.struct(*music, _name_keys(side["composers"]).alias("composers"), core.alias("core"), _grams(side["title"]).alias("grams"))


def same_works(a: Column, b: Column) -> Column:
    """Some work of one prepared side agrees with one of the other."""
    return F.exists(a["works"], lambda x: F.exists(b["works"], lambda y: _prepared_works_agree(x, y)))


def same_names(a: Column, b: Column, which: str) -> Column:
    """Some of the ``which`` (performers or composers) of prepared sides agree."""
    return _keys_agree(a[which], b[which])


def same_title(a: Column, b: Column) -> Column:
    return F.coalesce(a["core"] == b["core"], F.lit(False))


def prepared_verdict(a: Column, b: Column, titles: bool = True) -> Column:
    """musical_verdict of two prepared sides; without ``titles``, as if they had none."""
    title = same_title(a, b) if titles else F.lit(False)
    facts = F.struct(same_works(a, b).alias("works"), same_names(a, b, "performers").alias("performers"), title.alias("title"), (a["some_performers"] & b["some_performers"]).alias("both_performers"), (a["some_works"] & b["some_works"]).alias("both_works"))

    def judged(f: Column) -> Column:
        out = F.when(f["both_performers"] & ~f["performers"] & ~(f["works"] | f["title"]), "conflict").when(f["works"], "match")
        out = out.when(f["both_works"], "conflict").when(f["performers"], "match")
        if titles:
            out = out.when(f["title"] | F.arrays_overlap(a["grams"], b["grams"]) & same_names(a, b, "composers"), "match")
        return out.otherwise("insufficient")

    return once(facts, judged)


def musical_verdict(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """match, conflict or insufficient from performers, works, composers (arrays, folded) and title (folded) of both sides. Where a side is in
    many pairs, prepare it once and ask prepared_verdict."""
    return once(F.struct(prepared(a).alias("a"), prepared(b).alias("b")), lambda s: prepared_verdict(s["a"], s["b"]))


def source_verdict(music: Column, place: Column, same_slot: Column, same_date: Column, dated: Column, status: Column, continuity: Column, covers: Column) -> Column:
    """compatible, incompatible or review for an observation and the published event that its source points to.

    ``music``: musical_verdict; ``place``: linkage.venue_relation from the observation to the event; ``same_slot`` and ``same_date``: they share
    a date and time, or a date; ``dated``: both have dates; ``status``: the observation's; ``continuity``: same source
    item before; ``covers``: a cancellation names all dates that are published.
    """
    apart, same_place = dated & ~same_date, place.isin("same", "refinement", "absent")
    postponed, cancelled = status == "postponed", status == "cancelled"
    out = F.when(postponed & (music == "conflict"), "review").when((music == "conflict") & apart, "incompatible")
    out = out.when(music == "conflict", F.when(dated & ~same_slot, "incompatible").otherwise("review"))
    out = out.when(cancelled & ~(covers & same_place), "review")
    out = out.when(place == "coarser", F.when((music == "match") & same_slot & ~cancelled, "compatible").otherwise("review"))
    out = out.when(~same_place, F.when(continuity & postponed, "compatible").when(apart, "incompatible").otherwise("review"))
    return out.when(same_slot, "compatible").when(continuity & (same_date | postponed), "compatible").otherwise("review")


def recyclable_verdict(music: Column, place: Column, same_slot: Column) -> Column:
    """The stricter verdict for sources that use one address for event after event: music, place and slot must all agree."""
    out = F.when((music == "match") & place.isin("same", "refinement") & same_slot, "compatible")
    return out.when((music == "conflict") | place.isin("unrelated", "sibling"), "incompatible").otherwise("review")


def resolve(hits: DataFrame, slots: DataFrame, id_col: str, sure: Sequence[str] = ("external-id", "url")) -> DataFrame:
    """(id, action, method, event, n): what an observation is, from its candidates and, failing those, its slot.

    ``hits``: (id, event, method, verdict, owns_date, overlaps) - verdict as ``source_verdict`` for sure methods, ``owns_date`` if the event has the
    observed date, ``overlaps`` if its dates overlap those of other hits. ``slots``: (id, event, music) for events that hold the observation's exclusive slot.
    """
    weighed = hits.where(F.col("verdict") != "incompatible")
    owner = F.max(F.col("owns_date").cast("int")).over(Window.partitionBy(id_col))  # an owner of the date outranks mere plausibility
    weighed = weighed.withColumn("owned", owner).where((F.col("owned") == 0) | F.col("owns_date"))
    found = weighed.groupBy(id_col).agg(
        F.countDistinct("event").alias("n"), F.min("event").alias("event"), F.min_by("method", F.struct(F.array_position(F.array(*map(F.lit, (*sure, "alias", "strong"))), F.col("method")), "event")).alias("method"),
        F.count_if(~F.col("method").isin(*sure)).alias("unsure"), F.count_if(F.col("verdict") == "review").alias("reviews"), F.count_if("overlaps").alias("overlaps"),
    )
    action = F.when(F.col("reviews") > 0, "ambiguous").when(F.col("n") == 1, "matched").when((F.col("unsure") > 0) | (F.col("overlaps") > 0), "ambiguous").otherwise("matched-many")
    first = found.select(id_col, action.alias("action"), "method", "event", "n")
    held = slots.join(found.select(id_col), id_col, "left_anti").groupBy(id_col).agg(
        F.count_if(F.col("music") == "match").alias("matches"), F.count_if(F.col("music") == "conflict").alias("conflicts"),
        F.min(F.when(F.col("music") == "match", F.col("event"))).alias("match"), F.countDistinct("event").alias("n"), F.min("event").alias("least"),
    )
    sole = (F.col("matches") == 1) & (F.col("conflicts") == 0)
    second = held.select(id_col, F.when(sole, "matched").otherwise("ambiguous").alias("action"), F.lit("slot").alias("method"), F.coalesce("match", "least").alias("event"), "n")
    return first.unionByName(second)
