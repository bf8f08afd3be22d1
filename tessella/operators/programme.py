"""Programmes on pages: which lines are notices, which are cast and which are works, by a state that runs down a page's lines.

A rule table says what kind a line is (the first rule that holds wins); headings open a section. Where a page has no heading, the programme begins with the first line that
must be a work, with the composers' lines right before it. All is window work over a page's lines; a page's lines are never gathered in one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import unaccent

#: Kind and pattern over the line without accents in lower case, in order; the defaults are short and meant to be extended.
RULES: tuple[tuple[str, str], ...] = (
    ("notice", r"\b(?:aviso|cancelad[oa]|aplazad[oa]|suspendid[oa]|devolucion|huelga|notice|cancelled|postponed)\b"),
    ("cast-heading", r"^(?:interpretes?|reparto|elenco|artistas|ficha artistica|cast|performers?)\s*:?$"),
    ("programme-heading", r"^(?:programa|obras|repertorio|program(?:me)?)\s*:?$"),
    ("other-heading", r"^(?:entradas|venta|horario|biografia|como llegar|patrocina\w*|tickets|biography)\s*:?$"),
    ("work", r"\b(?:op|bwv|kv?|hob|d|rv|hwv|woo)\.? ?[0-9]+\b|\b(?:sinfonia|sonata|concierto para|cuarteto|quinteto|misa|requiem|suite|obertura|preludio|cantata|symphony|concerto)\b"),
    ("role", r"[,:(]\s*(?:piano|violin|viola|violonchelo|director[a]?|soprano|tenor|baritono|bajo|flauta|organo|guitarra|clave|conductor|cello|organ)\b\s*\)?\s*$"),
    ("composer", r"^[a-z][a-z. '-]+\(\s*\*?[0-9]{4}\s*(?:-\s*[0-9]{0,4})?\s*\)$"),
)
HEADINGS = {"cast-heading": "cast", "programme-heading": "programme", "other-heading": "other"}


def kind_of(line: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """What kind of line this is; "text" if no rule holds."""
    folded = unaccent(line)
    out = None
    for kind, pattern in rules:
        out = F.when(folded.rlike(pattern), kind) if out is None else out.when(folded.rlike(pattern), kind)
    return F.lit("text") if out is None else out.otherwise("text")


def segmented(lines: DataFrame, page: str, place: str, line: str, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """lines with ``kind`` and ``section``: notice, heading, cast, programme, other, or "open" where nothing says.

    Under a heading lines are of its section until the next heading. Before any heading a work opens the programme for all that follows, and composers' lines right before it go
    with it; lines with a role are cast until then. Notices are taken out before, wherever they stand, and open nothing.
    """
    typed = lines.withColumn("kind", kind_of(F.col(line), rules))
    over = Window.partitionBy(page).orderBy(place)
    so_far, before = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))
    typed = typed.withColumn("_head", F.last(F.try_element_at(heading, F.col("kind")), ignorenulls=True).over(so_far))
    # composers' lines up to a work: the next line that is neither a composer's nor a notice
    ahead = over.rowsBetween(1, Window.unboundedFollowing)
    typed = typed.withColumn("_next", F.first(F.when(~F.col("kind").isin("composer", "notice"), F.col("kind")), ignorenulls=True).over(ahead))
    opens = (F.col("kind") == "work") | ((F.col("kind") == "composer") & (F.col("_next") == "work"))
    typed = typed.withColumn("_open", F.max((opens & F.col("_head").isNull()).cast("int")).over(so_far))
    section = F.when(F.col("kind") == "notice", "notice").when(F.col("kind").isin(*HEADINGS), "heading").when(F.col("_head").isNotNull(), F.col("_head"))
    section = section.when(F.col("_open") == 1, "programme").when(F.col("kind") == "role", "cast").otherwise("open")
    return typed.withColumn("section", section).drop("_head", "_next", "_open")


def patches(segments: DataFrame, page: str, place: str, line: str) -> DataFrame:
    """(page, place, field, name, detail) of what the lines add to an event: performers with their role, works with the composer whose line stands before them, notices."""
    typed = segments.withColumn("_line", F.trim(F.regexp_replace(line, r"\s+", " ")))
    over = Window.partitionBy(page).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    composer = F.when((F.col("kind") == "composer") & (F.col("section") == "programme"), F.trim(F.regexp_replace("_line", r"\s*\([^()]*\)$", ""))).when(F.col("section") == "heading", "")
    typed = typed.withColumn("_composer", F.nullif(F.last(composer, ignorenulls=True).over(over), F.lit("")))
    parts = F.regexp_extract("_line", r"^(.*?)\s*[,:(]\s*([^,:()]*)\)?\s*$", 1), F.regexp_extract("_line", r"^(.*?)\s*[,:(]\s*([^,:()]*)\)?\s*$", 2)
    field = F.when(F.col("section") == "notice", "notice").when((F.col("section") == "programme") & (F.col("kind") == "work"), "work").when((F.col("section") == "cast") & F.col("kind").isin("role", "text"), "performer")
    name = F.when((field == "performer") & (F.col("kind") == "role"), parts[0]).otherwise(F.col("_line"))
    detail = F.when(field == "work", F.col("_composer")).when((field == "performer") & (F.col("kind") == "role"), F.trim(parts[1]))
    return typed.select(page, place, field.alias("field"), name.alias("name"), detail.alias("detail")).where("field is not null")
