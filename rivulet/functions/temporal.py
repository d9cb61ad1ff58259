"""Date, time and interval functions. Timestamps carry no zone."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format codes and the patterns of date_format that print the same.
PATTERNS = {
    "a": "E", "A": "EEEE", "d": "dd", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "m": "MM", "y": "yy", "Y": "yyyy", "Q": "q",
    "D": "MM/dd/yy", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "z": "xxx", "R": "HH:mm", "T": "HH:mm:ss",
}
PARTS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def _special(code: str, c: Column) -> Column | None:
    year, week = F.extract(F.lit("yearofweek"), c), F.weekofyear(c)
    found = {
        "w": lambda: F.dayofweek(c).cast("string"),
        "C": lambda: F.lpad(F.ceil(F.year(c) / 100).cast("string"), 2, "0"),
        "G": lambda: year.cast("string"),
        "g": lambda: F.lpad((year % 100).cast("string"), 2, "0"),
        "V": lambda: F.lpad(week.cast("string"), 2, "0"),
        "u": lambda: F.extract(F.lit("dayofweek_iso"), c).cast("string"),
        "Z": lambda: F.current_timezone(),
    }.get(code)
    return found() if found else None


def strftime(c: Column, fmt: str) -> Column:
    """Format by C codes; unknown codes warn and stay as they are."""
    parts: list[Column] = []
    plain = ""
    for m in re.finditer(r"%(.)|[^%]+|%", fmt, re.S):
        code = m[1]
        if code in PATTERNS:
            plain += PATTERNS[code]
            continue
        special = _special(code, c) if code else None
        if special is not None:
            if plain:
                parts.append(F.date_format(c, plain))
                plain = ""
            parts.append(special)
            continue
        if code:
            warnings.warn(f"format code %{code} isn't supported", stacklevel=2)
        plain += "'" + m[0].replace("'", "''") + "'"
    if plain:
        parts.append(F.date_format(c, plain))
    return F.concat(*parts) if parts else F.lit("")


def date_trunc(part: str, c: Column) -> Column:
    if part not in PARTS:
        raise ValueError(f"{part} isn't one of {PARTS}")
    return F.date_trunc(part, c).cast("timestamp_ntz")


def total_microseconds(interval: Column) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, zero + interval)


def total_seconds(interval: Column) -> Column:
    return total_microseconds(interval) / 1_000_000


def components(interval: Column) -> dict[str, Column]:
    """days, hours, minutes, seconds, milliseconds, microseconds; only days are negative."""
    us = total_microseconds(interval)
    rest = F.pmod(us, F.lit(86_400_000_000))
    return {
        "days": F.floor(us / 86_400_000_000).cast("long"),
        "hours": F.floor(rest / 3_600_000_000).cast("long"),
        "minutes": F.floor(rest / 60_000_000).cast("long") % 60,
        "seconds": F.floor(rest / 1_000_000).cast("long") % 60,
        "milliseconds": F.floor(rest / 1000).cast("long") % 1000,
        "microseconds": rest % 1000,
    }


def date_plus(d: Column, interval: Column) -> Column:
    """date + interval, to the nearest day."""
    return (d.cast("timestamp_ntz") + interval + F.expr("interval '12' hour")).cast("date")


def date_minus(d: Column, interval: Column) -> Column:
    """date - interval, to the nearest day."""
    return (d.cast("timestamp_ntz") - interval + F.expr("interval '12' hour")).cast("date")


def date_minus_date(a: Column, b: Column) -> Column:
    """A span of whole days."""
    return F.make_dt_interval(F.date_diff(a, b))


def from_microseconds(us: Column) -> Column:
    """A time span of so many microseconds."""
    us = F.round(us).cast("long")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / 1_000_000).cast("decimal(18,6)"))


def seconds(interval: Column) -> Column:
    """Whole seconds of the last day begun."""
    return F.floor(F.pmod(total_microseconds(interval), F.lit(86_400_000_000)) / 1_000_000).cast("long")


def microseconds(interval: Column) -> Column:
    """Microseconds of the last second begun."""
    return F.pmod(total_microseconds(interval), F.lit(1_000_000))


def parse_interval(text: Column) -> Column:
    """A time span from ISO 8601 text such as P1DT2H3M4.5S, or with W for weeks; null for other texts."""
    shape = r"^(-)?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda k, kind: F.coalesce(F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast(kind), F.lit(0).cast(kind))
    made = F.make_dt_interval(part(2, "int") * 7 + part(3, "int"), part(4, "int"), part(5, "int"), part(6, "decimal(18,6)"))
    return F.when(text.rlike(shape) & (text.rlike(r"\d")), F.when(F.regexp_extract(text, shape, 1) == "-", -made).otherwise(made))


def to_time(c: Column) -> Column:
    """The time of day as text, to the microsecond."""
    return F.date_format(F.when(c.cast("string").rlike(r"^\d{1,2}:"), F.concat(F.lit("1970-01-01 "), c.cast("string"))).otherwise(c.cast("string")).cast("timestamp_ntz"), "HH:mm:ss.SSSSSS")
