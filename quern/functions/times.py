"""Dates and times; instants are epoch seconds as doubles, zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(t: Column) -> Column:
    """A timestamp as epoch seconds with its fraction."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def instant(c: Column) -> Column:
    return F.timestamp_micros(F.round(c * 1e6).cast("bigint"))


def parse_iso(c: Column) -> Column:
    """ISO text, from a year alone to fractions and a zone (applied), or a number, as epoch seconds; else null."""
    s = F.trim(c)
    full = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^(\d{4})$", "$1-01-01"), r"^(\d{4}-\d{2})$", "$1-01"), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    iso = F.when(s.rlike(r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"), epoch(full.try_cast("timestamp")))
    return F.coalesce(F.when(~s.rlike(r"^\d{4}$"), s.try_cast("double")), iso)


def parse_format(c: Column, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    return epoch(F.try_to_timestamp(c, F.lit(fmt)))


def flat_to_iso(c: Column) -> Column:
    """YYYYMMDDhhmmss -> ISO."""
    return F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")


def iso(c: Column) -> Column:
    return F.date_format(instant(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(instant(c), fmt)


def collapse(c: Column) -> Column:
    """struct(y, d, h, m, s) of a number of seconds; a year has 365 days."""
    s = F.floor(c).cast("bigint")
    at = lambda by, mod=None: F.floor(F.pmod(s, F.lit(mod)) / by if mod else s / by).cast("bigint")
    return F.struct(at(31_536_000).alias("y"), at(86_400, 31_536_000).alias("d"), at(3600, 86_400).alias("h"), at(60, 3600).alias("m"), F.pmod(s, F.lit(60)).alias("s"))


def hms(c: Column) -> Column:
    s = F.floor(c).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.pmod(F.floor(s / 60).cast("bigint"), F.lit(60)), F.pmod(s, F.lit(60)))


def elapsed(c: Column) -> Column:
    """A short label of the largest unit: years, months of 30 days, weeks, days, hours, minutes, seconds."""
    d = F.floor(c / 86_400).cast("bigint")
    unit = lambda n, u: F.concat(n.cast("bigint").cast("string"), F.lit(u))
    return (
        F.when(d >= 365, unit(F.floor(d / 365), "y"))
        .when(d >= 30, unit(F.floor(d / 30), "mo"))
        .when(d >= 7, unit(F.floor(d / 7), "w"))
        .when(d >= 1, unit(d, "d"))
        .when(c >= 3600, unit(F.floor(c / 3600), "h"))
        .when(c >= 60, unit(F.floor(c / 60), "m"))
        .otherwise(unit(F.floor(c), "s"))
    )


def names(c: Column) -> Column:
    """What an instant is called: year, month, date, weekday, weekend or weekday, part of the day."""
    t = instant(c)
    h = F.hour(t)
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    weekend = F.when(F.weekday(t) >= 5, "weekend").otherwise("weekday")
    return F.array(F.date_format(t, "yyyy"), F.date_format(t, "MMMM"), F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "EEEE"), weekend, part)


def context(c: Column) -> Column:
    """[day of the week from Monday = 0, hour]."""
    t = instant(c)
    return F.array(F.weekday(t).cast("double"), F.hour(t).cast("double"))


def recency(a: Column, b: Column, log: bool = False) -> Column:
    d = b - a
    return F.log1p(F.greatest(d, F.lit(0.0))) if log else d


def time_left(done: Column, total: Column, spent: Column) -> Column:
    """Time until the rest is done at the rate so far."""
    return F.when(done > 0, spent / done * (total - done))


def utc_offset(c: Column, zone: str) -> Column:
    """Seconds that a zone's clock is ahead of UTC at an instant."""
    t = instant(c)
    return epoch(F.from_utc_timestamp(t, zone)) - epoch(t)
