"""Time parsing and printing on zone-less timestamps, independent of the session time zone.

The usual layouts are read by built-in parsers. Rarer spellings that are still valid take a second, slower route, which
is only evaluated for the texts the first one rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import bind, pattern

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_DMY = pattern(r"^(\d{1,2})/(\w{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\s+(Z|[+-]\d\d:?[0-5]\d))?$")
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"
_YMD_DASH = pattern(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+|[Tt])(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d{1,6})?)$")
_YMD_SLASH = pattern(r"^(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$")
_MON_D = pattern(r"^(\w{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$")


def naive(text: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss[.f]' to TIMESTAMP_NTZ; NULL if it names no real moment. Digits past µs are cut."""
    return F.when(~text.startswith("0000"), text.try_cast("timestamp_ntz"))


def shifted(ts: Column, seconds: Column) -> Column:
    return F.try_add(ts, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_instant(ts: Column) -> Column:
    """TIMESTAMP_NTZ taken as UTC, as the TIMESTAMP that watermarks need."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch(), ts))


def from_instant(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch())


def utc(text: Column, layout: str) -> Column:
    """Text with a zone offset, read by the built-in parser and given as TIMESTAMP_NTZ in UTC."""
    return F.timestamp_add("SECOND", F.unix_seconds(F.try_to_timestamp(text, F.lit(layout))), epoch())


def _month(name: Column) -> Column:
    place = F.array_position(F.split(F.lit(MONTHS), " "), F.lower(name))
    return F.when(place > 0, F.lpad(place.cast("string"), 2, "0"))


def _joined(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    time = F.concat_ws(":", F.lpad(hour, 2, "0"), F.lpad(minute, 2, "0"), second)
    return F.when(month.isNotNull(), naive(F.concat_ws(" ", date, time)))


def _any_day_month_year(text: Column) -> Column:
    def part(i):
        return F.regexp_extract(text, _DMY, i)

    local = _joined(part(3), _month(part(2)), part(1), part(4), part(5), F.lpad(part(6), 2, "0"))
    zone = part(7)
    hours = F.substring(zone, 2, 2).try_cast("int")
    seconds = hours * 3600 + F.substring(zone, -2, 2).try_cast("int") * 60
    moved = shifted(local, F.when(zone.startswith("-"), seconds).otherwise(-seconds))
    return F.when(zone.isin("", "Z"), local).when(hours < 24, moved)


def day_month_year(text: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS with an optional zone, moved to UTC when a zone is given."""
    return F.coalesce(utc(text, "dd/MMM/yyyy:HH:mm:ss Z"), bind(text, _any_day_month_year))


def day_month_year_unzoned(text: Column) -> Column:
    return bind(text, lambda t: F.when(F.regexp_extract(t, _DMY, 7) == "", _any_day_month_year(t)))


def year_month_day(text: Column) -> Column:
    """Dashed dates, blank or T before the time, optional fraction up to microseconds."""

    def parsed(t):
        parts = [F.regexp_extract(t, _YMD_DASH, i) for i in range(1, 7)]
        second = F.when(F.instr(parts[5], ".") == 2, F.concat(F.lit("0"), parts[5])).otherwise(parts[5])
        return _joined(*parts[:5], F.when(F.length(second) == 1, F.concat(F.lit("0"), second)).otherwise(second))

    return F.when(text.rlike(_ISO), naive(text)).otherwise(bind(text, parsed))


def slashed(text: Column) -> Column:
    def parsed(t):
        parts = [F.regexp_extract(t, _YMD_SLASH, i) for i in range(1, 7)]
        return _joined(*parts[:5], F.lpad(parts[5], 2, "0"))

    return bind(text, parsed)


def month_day(text: Column, year: Column) -> Column:
    """Mon d HH:MM:SS in a given year, any spacing."""

    def parsed(t):
        month, day, hour, minute, second = [F.regexp_extract(t, _MON_D, i) for i in range(1, 6)]
        return _joined(year, _month(month), day, hour, minute, F.lpad(second, 2, "0"))

    dated = F.concat(year, F.lit(" "), F.replace(text, F.lit("  "), F.lit(" ")), F.lit(" +0000"))
    return F.coalesce(utc(dated, "yyyy MMM d HH:mm:ss Z"), bind(text, parsed))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two TIMESTAMP_NTZ columns in seconds, as a double exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1_000_000.0)


def _printed(ts: Column, layout: str, when_null) -> Column:
    whole = F.date_format(ts, layout)
    micros = F.date_format(ts, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.coalesce(text, F.lit(when_null))


def spaced(ts: Column, when_null: str | None = "0001-01-01 00:00:00") -> Column:
    return _printed(ts, "yyyy-MM-dd HH:mm:ss", when_null)


def iso(ts: Column, when_null: str | None = None) -> Column:
    return _printed(ts, "yyyy-MM-dd'T'HH:mm:ss", when_null)
