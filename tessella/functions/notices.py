"""Dates, times and changes as Spanish prose and feeds write them, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .civil import ZONE
from .text import once, unaccent

#: Month and weekday names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
DAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
_DATE = rf"\b([0-9]{{1,2}}) (?:de )?({'|'.join(MONTHS)}|setiembre)(?: (?:de |del )?([0-9]{{4}}))?"
_TIME = r"\b([01]?[0-9]|2[0-3])[:.h]([0-5][0-9])\b"


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.when(name == "setiembre", "septiembre").otherwise(name)).cast("int")


def _made(text: Column, year: Column) -> Column:
    at = lambda k: F.regexp_extract(text, _DATE, k)
    stated = F.coalesce(F.nullif(at(3), F.lit("")).cast("int"), year)
    return F.when(at(1) != "", F.try_to_date(F.concat_ws("-", F.lpad(stated.cast("string"), 4, "0"), F.lpad(_month(at(2)).cast("string"), 2, "0"), F.lpad(at(1), 2, "0")), "yyyy-MM-dd"))


def spanish_date(text: Column, year: Column | None = None) -> Column:
    """The first date such as "11 de abril de 2027"; one without a year has ``year`` or is none."""
    return once(unaccent(text), lambda t: _made(t, F.lit(None).cast("int") if year is None else year))


def clock(text: Column) -> Column:
    """The first time of day such as 19:30, 19.30 or 19h30, as HH:mm."""
    found = lambda k: F.regexp_extract(text, _TIME, k)
    return F.when(found(1) != "", F.concat_ws(":", F.lpad(found(1), 2, "0"), found(2)))


def notice(text: Column, year: Column | None = None) -> Column:
    """struct(status, date): what a notice says of its event - cancelled, postponed (and to when, if it says so), else scheduled."""

    def told(t: Column) -> Column:
        put_off = r"\b(?:aplazad[oa]s?|se aplaza|pospuest[oa]s?|postponed|trasladad[oa]s?)\b"
        after = F.regexp_extract(t, rf"{put_off}(.*)", 1)
        target = _made(F.regexp_extract(after, r"(?:al|hasta el|para el|a) (.*)", 1), F.lit(None).cast("int") if year is None else year)
        cancelled = t.rlike(r"\b(?:cancelad[oa]s?|se cancela|suspendid[oa]s?|cancelled)\b")
        status = F.when(t.rlike(put_off), "postponed").when(cancelled, "cancelled").otherwise("scheduled")
        return F.struct(status.alias("status"), F.when(t.rlike(put_off), target).alias("date"))

    return once(F.regexp_replace(unaccent(F.coalesce(text, F.lit(""))), r"\s+", " "), told)


_OBSERVED = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:(Z)|([+-])(\d{2}):?(\d{2}))?)?$"


def observed(text: Column, zone: str = ZONE) -> Column:
    """struct(date, time) of what a feed gives: an instant with an offset (Z, +hh:mm or +hhmm) in the zone's civil time, a time without one
    as it is, or a bare date; seconds may be missing. Both are null for what is no such value, or an impossible date, time or offset."""

    def told(t: Column) -> Column:
        at = lambda k: F.nullif(F.regexp_extract(t, _OBSERVED, k), F.lit(""))
        number = lambda k: at(k).cast("int")
        day = F.try_to_date(at(1), "yyyy-MM-dd")
        within = lambda k, most: number(k).isNull() | (number(k) <= most)
        real = day.isNotNull() & within(2, 23) & within(3, 59) & within(4, 59) & within(7, 23) & within(8, 59)
        offset = F.when(at(5).isNotNull(), 0).otherwise((number(7) * 60 + number(8)) * F.when(at(6) == "-", -1).otherwise(1))
        minutes = F.datediff(day, F.lit("1970-01-01").cast("date")) * 1440 + number(2) * 60 + number(3) - offset
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MINUTE", minutes, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
        told_day, told_time = F.when(offset.isNull(), day).otherwise(F.to_date(local)), F.when(offset.isNull(), F.concat_ws(":", at(2), at(3))).otherwise(F.date_format(local, "HH:mm"))
        return F.struct(F.when(real, told_day).alias("date"), F.when(real & at(2).isNotNull(), told_time).alias("time"))

    return once(F.trim(text), told)


def long_date(date: Column) -> Column:
    """A date in Spanish, such as "domingo, 11 de abril de 2027"."""
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(date) + 1)
    return F.concat(day, F.lit(", "), F.dayofmonth(date).cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date)), F.lit(" de "), F.year(date).cast("string"))
