"""Date and time functions. All take the moment of reference as an argument; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(F.to_date(day), F.dayofweek(day) - 1)


def week_end(day) -> Column:
    return F.date_add(week_start(day), 6)


def same_day(a, b) -> Column:
    return F.to_date(a) == F.to_date(b)


def same_month(a, b) -> Column:
    return F.trunc(a, "MM") == F.trunc(b, "MM")


def minute_of_day(x) -> Column:
    return F.hour(x) * 60 + F.minute(x)


def minutes_between(a, b) -> Column:
    """Whole minutes from a to b, toward zero."""
    return F.timestamp_diff("MINUTE", a, b)


def day_fraction(x) -> Column:
    """Position within the day in percent."""
    return minute_of_day(x) / F.lit(1440.0) * 100


def fractional_hour(x) -> Column:
    return F.hour(x) + F.minute(x) / F.lit(60.0)


def _minutes(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def add_minutes(x, n) -> Column:
    return x + _minutes(n if isinstance(n, Column) else F.lit(n))


def snap_15(x) -> Column:
    """The nearest quarter of an hour: less than 7.5 minutes down, else up; seconds go if the minute isn't on a quarter."""
    over = F.minute(x) % 15
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.second(x).cast("decimal(18,6)"))
    return F.when(over == 0, x).when(over < 7.5, add_minutes(x - seconds, -over)).otherwise(add_minutes(x - seconds, 15 - over))


def snap_quarter(hours) -> Column:
    """The minutes of a fractional hour on the quarter; the last one never rolls over."""
    part = hours - F.floor(hours)
    return F.when(part < 0.125, 0).when(part < 0.375, 15).when(part < 0.625, 30).otherwise(45)


def floor_15(x) -> Column:
    return (F.floor(F.minute(x) / 15) * 15).cast("int")


def moved(start, end, new_start) -> Column:
    """The end that keeps an interval's whole minutes after its start has moved."""
    return add_minutes(new_start, minutes_between(start, end))


def minute_changed(a, b) -> Column:
    """Whether two moments differ, seconds aside."""
    return F.date_trunc("minute", a) != F.date_trunc("minute", b)


def short_time(x) -> Column:
    """``1pm`` on the hour, else ``1:05pm``."""
    return F.lower(F.when(F.minute(x) == 0, F.date_format(x, "ha")).otherwise(F.date_format(x, "h:mma")))


def period_title(first, last) -> Column:
    """One month's name, or the two that a period spans."""
    return F.when(same_month(first, last), F.date_format(first, "MMMM yyyy")).otherwise(F.concat_ws(" - ", F.date_format(first, "MMM"), F.date_format(last, "MMM yyyy")))


def ago(x, as_of) -> Column:
    """How long before ``as_of``: the largest whole unit."""
    out = F.lit("just now")
    for unit, name in (("MINUTE", "minute"), ("HOUR", "hour"), ("DAY", "day"), ("MONTH", "month"), ("YEAR", "year")):
        n = F.timestamp_diff(unit, x, as_of)
        out = F.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return out


def navigate(day, view: str, step: int) -> Column:
    """The day one period on (or back): month, week, day, or an agenda of 30 days."""
    return F.to_date(F.add_months(day, step)) if view == "month" else F.date_add(F.to_date(day), {"week": 7, "day": 1, "agenda": 30}[view] * step)


def default_end(start, end=None, minutes: int = 30) -> Column:
    """The end, or half an hour after the start where there is none."""
    later = add_minutes(start, F.lit(minutes))
    return later if end is None else F.coalesce(end, later)


def to_local(x, zone: str) -> Column:
    """What a zone's clocks show at a moment in UTC (both without a zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x.cast("timestamp_ntz"))


def to_utc(x, zone: str) -> Column:
    """The moment in UTC at which a zone's clocks show a time. A time that they show twice is the first of them; one that they skip is as long after the gap's start."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), x.cast("timestamp_ntz"))


def local_hour(x, zone: str) -> Column:
    """The hour of a moment in UTC (without a zone) where the zone's clocks stand."""
    return F.hour(to_local(x, zone))


def local_day(x, zone: str) -> Column:
    return F.to_date(to_local(x, zone))


def local_day_start(day, zone: str) -> Column:
    """The moment in UTC at which a zone's day begins (where midnight is skipped, the first time after it)."""
    return to_utc(F.to_date(day), zone)


def local_day_hours(day, zone: str) -> Column:
    """How long a zone's day is: 24 hours, fewer or more where the clocks change in it."""
    return F.timestamp_diff("MINUTE", local_day_start(day, zone), local_day_start(F.date_add(F.to_date(day), 1), zone)) / F.lit(60.0)


def is_second_hour(x, zone: str) -> Column:
    """Whether a zone's clocks show a moment's time for the second time, after they were put back."""
    return to_utc(to_local(x, zone), zone) < x.cast("timestamp_ntz")


def to_iso(x) -> Column:
    """A moment in UTC as ``2024-01-02T03:04:05.678Z``."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text) -> Column:
    """A moment in UTC (without a zone) from ISO text with a zone or without (then it is in UTC); null if it isn't one."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz"))


def clock(text) -> Column:
    """``hour`` and ``minute`` of ``HH:mm``; a part that is missing is 0, one that is no number null."""
    part = lambda i: F.coalesce(F.get(F.split(text, ":"), F.lit(i)), F.lit("0")).try_cast("int")
    return F.struct(part(0).alias("hour"), part(1).alias("minute"))
