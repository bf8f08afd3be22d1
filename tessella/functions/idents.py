"""Identifiers of events and sessions, and titles that don't shout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, fold, once

ROMAN = r"^[IVXLCDM]+$"
#: Words in capitals that stay so.
ACRONYMS = ("RTVE", "ORCAM", "JONDE", "OCNE", "CNDM", "BWV", "KV", "TV", "UCM")


def tail(text: Column, most: int = 120) -> Column:
    return F.regexp_replace(F.left(F.replace(fold(text), F.lit(" "), F.lit("_")), F.lit(most)), "_+$", "")


def event_id(text: Column) -> Column:
    return F.concat(F.lit("evt_"), tail(text))


def occurrence_id(event: Column, place: Column) -> Column:
    """The event's tail with the session's place in two digits at least."""
    number = place.cast("string")
    return F.concat(F.lit("occ_"), F.regexp_replace(event, "^evt_", ""), F.lit("_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


def quiet(title: Column, keep: Sequence[str] = ACRONYMS) -> Column:
    """A title all in capitals with capitals only where words begin (acronyms and Roman numbers stay), without a full stop at its end."""

    def told(t: Column) -> Column:
        loud = (F.upper(t) == t) & t.rlike(r"\p{L}{3}")
        word = lambda w: F.when(w.isin(*keep) | w.rlike(ROMAN), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
        return F.when(loud, F.array_join(F.transform(F.split(t, " "), word), " ")).otherwise(t)

    return once(F.regexp_replace(collapse(title), r"(?<=[^.])\.$", ""), told)
