"""Civil dates and times in one zone. ``now`` is always given as ``yyyy-MM-dd HH:mm``, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Madrid"


def day(text: Column) -> Column:
    """A real yyyy-MM-dd date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def upcoming(date: Column, now: str, time: Column | None = None) -> Column:
    """After today, or today at an unknown or not yet past time."""
    today, clock = F.lit(now[:10]).cast("date"), now[11:16]
    later = F.lit(True) if time is None else time.isNull() | (time >= clock)
    return (date > today) | ((date == today) & later)


def weekend(date: Column) -> tuple[Column, Column]:
    """First and last day of what is left of the weekend (Friday to Sunday) on or after a date."""
    number = F.weekday(date)  # Monday is 0
    return F.when(number >= 4, date).otherwise(F.date_add(date, 4 - number)), F.date_add(date, 6 - number)


def season_end(date: Column) -> Column:
    """The next 31 July."""
    return F.make_date(F.year(date) + F.when(F.month(date) >= 8, 1).otherwise(0), F.lit(7), F.lit(31))


def months(first: Column, last: Column) -> Column:
    """yyyy-MM of every month that a range of dates touches."""
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def to_utc(local: Column, zone: str = ZONE) -> Column:
    """The instant (as a UTC timestamp) of a civil time; of two the later, in a gap an hour on."""
    first = F.to_utc_timestamp(local.cast("timestamp"), zone)
    later = first + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(later, zone) == local.cast("timestamp"), later).otherwise(first)


def today(instant: Column, zone: str = ZONE) -> Column:
    """The civil day of an instant (a UTC timestamp)."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def time_of_day(instant: Column, zone: str = ZONE) -> Column:
    """The civil time of an instant as HH:mm."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "HH:mm")


def iso(date: Column, time: Column, zone: str = ZONE) -> Column:
    """A civil day and time with its offset from UTC, or the bare day where the time is unknown."""
    local = F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time).cast("timestamp")
    minutes = F.floor((F.unix_timestamp(local) - F.unix_timestamp(to_utc(local, zone))) / 60)
    sign = F.when(minutes < 0, "-").otherwise("+")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    offset = F.concat(sign, part(F.floor(F.abs(minutes) / 60)), F.lit(":"), part(F.abs(minutes) % 60))
    return F.when(time.isNull(), F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset))


def days_until(date: Column, now: Column) -> Column:
    """Days from one day to another, none if it is past."""
    return F.when(date >= now, F.datediff(date, now))
