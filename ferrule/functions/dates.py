"""Date and time functions of the dialect on texts, timestamps and (with 'unixepoch' or 'auto') numbers.

A time value is a Spark TIMESTAMP in UTC; a text or modifier that is not understood makes it NULL. Modifiers are
constants and become plain expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.operators import lit

_DAY, _ZONE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"(Z|[+-][0-9]{2}:[0-9]{2})?"
_CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
#: Of the Julian day 2440587.5, 1970-01-01.
EPOCH_DAY = 2440587.5


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def parse(text: Column) -> Column:
    """'now', YYYY-MM-DD, HH:MM:SS[.fff][zone] (on 2000-01-01) or both with a space or T between."""
    t = F.trim(text)
    day = F.when(t.rlike(f"^{_DAY}$"), t.try_cast("timestamp"))
    clock = F.when(t.rlike(f"^{_CLOCK}{_ZONE}$"), F.concat(F.lit("2000-01-01T"), t).try_cast("timestamp"))
    both = F.when(t.rlike(f"^{_DAY}[ T]{_CLOCK}{_ZONE}$"), t.try_cast("timestamp"))
    return F.when(F.lower(t) == "now", F.current_timestamp()).otherwise(F.coalesce(day, both, clock))


def _whole_months(ts: Column, months: int, clamp: bool) -> Column:
    """months later on the same day of the month; a day beyond the month's end rolls on, or is the last with clamp."""
    first = F.add_months(F.trunc(ts, "month"), months)
    day = F.date_add(first, F.dayofmonth(ts) - 1)
    if clamp:
        day = F.least(day, F.last_day(first))
    return _from_micros(_micros(day.cast("timestamp")) + _micros(ts) - _micros(F.date_trunc("day", ts)))


def time_value(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    """value with modifiers as a TIMESTAMP. kind: string, timestamp or number (which needs unixepoch or auto)."""
    todo = [m.strip().lower() for m in modifiers]
    value = lit(value)
    if kind == "timestamp":
        ts = value.cast("timestamp")
    elif kind == "number":
        first = todo.pop(0) if todo and todo[0] in ("unixepoch", "auto") else None
        seconds = _from_micros(F.round(value.cast("double") * 1e6))
        julian = _from_micros(F.round((value.cast("double") - EPOCH_DAY) * 86_400_000) * 1000)
        if first is None:
            return F.lit(None).cast("timestamp")
        ts = F.when(value.between(0, 5373484.499999), julian).otherwise(seconds) if first == "auto" else seconds
    else:
        ts = parse(value)
    while todo:
        m = todo.pop(0)
        clamp = bool(todo) and todo[0] == "floor"
        if m in ("subsec", "subsecond", "floor", "ceiling"):
            continue
        if m in ("start of day", "start of month", "start of year"):
            ts = F.date_trunc(m.split()[-1], ts)
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(found[1])) - (F.dayofweek(ts) - 1), F.lit(7))
            ts = _from_micros(_micros(ts) + ahead * _UNITS["day"])
        elif found := re.fullmatch(r"([+-]?[0-9]+(?:\.[0-9]+)?) (day|hour|minute|second)", m):
            ts = _from_micros(_micros(ts) + round(float(found[1]) * _UNITS[found[2]]))
        elif found := re.fullmatch(r"([+-]?[0-9]+) (month|year)", m):
            ts = _whole_months(ts, int(found[1]) * (12 if found[2] == "year" else 1), clamp)
        else:
            return F.lit(None).cast("timestamp")
    return ts


def _fraction(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def date(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    return F.date_format(time_value(value, *modifiers, kind=kind), "yyyy-MM-dd")


def time(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    return F.date_format(time_value(value, *modifiers, kind=kind), "HH:mm:ss.SSS" if _fraction(modifiers) else "HH:mm:ss")


def datetime(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    return F.date_format(time_value(value, *modifiers, kind=kind), "yyyy-MM-dd HH:mm:ss.SSS" if _fraction(modifiers) else "yyyy-MM-dd HH:mm:ss")


def _julian(ts: Column) -> Column:
    return _micros(ts) / 86_400_000_000.0 + EPOCH_DAY


def julianday(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    return _julian(time_value(value, *modifiers, kind=kind))


def unixepoch(value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    """Seconds; with fractions (of milliseconds) under 'subsec'."""
    ts = time_value(value, *modifiers, kind=kind)
    return F.unix_millis(ts) / 1000.0 if _fraction(modifiers) else F.unix_seconds(ts)


def _two(x: Column, fill: str = "0") -> Column:
    return F.lpad(x.cast("string"), 2, fill)


def _weeks(ts: Column, monday: bool) -> Column:
    """Weeks since the first Sunday (or Monday) of the year."""
    day = F.weekday(ts) if monday else F.dayofweek(ts) - 1
    return F.floor((F.dayofyear(ts) - 1 + 7 - day) / 7).cast("int")


def _iso_year(ts: Column) -> Column:
    """The year of the week's Thursday."""
    return F.year(F.date_add(ts, 3 - F.weekday(ts)))


def _hour12(ts: Column) -> Column:
    return F.pmod(F.hour(ts) + 11, F.lit(12)) + 1


_DIRECTIVES: dict[str, Callable[[Column], Column]] = {
    "Y": lambda t: F.date_format(t, "yyyy"),
    "m": lambda t: F.date_format(t, "MM"),
    "d": lambda t: F.date_format(t, "dd"),
    "e": lambda t: _two(F.dayofmonth(t), " "),
    "H": lambda t: F.date_format(t, "HH"),
    "k": lambda t: _two(F.hour(t), " "),
    "I": lambda t: _two(_hour12(t)),
    "l": lambda t: _two(_hour12(t), " "),
    "M": lambda t: F.date_format(t, "mm"),
    "S": lambda t: F.date_format(t, "ss"),
    "f": lambda t: F.date_format(t, "ss.SSS"),
    "F": lambda t: F.date_format(t, "yyyy-MM-dd"),
    "T": lambda t: F.date_format(t, "HH:mm:ss"),
    "R": lambda t: F.date_format(t, "HH:mm"),
    "p": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"),
    "P": lambda t: F.when(F.hour(t) < 12, "am").otherwise("pm"),
    "j": lambda t: F.lpad(F.dayofyear(t).cast("string"), 3, "0"),
    "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "u": lambda t: (F.weekday(t) + 1).cast("string"),
    "s": lambda t: F.unix_seconds(t).cast("string"),
    "J": lambda t: F.regexp_replace(F.format_string("%.9f", _julian(t)), r"\.?0+$", ""),
    "U": lambda t: _two(_weeks(t, False)),
    "W": lambda t: _two(_weeks(t, True)),
    "V": lambda t: _two(F.weekofyear(t)),
    "G": lambda t: F.lpad(_iso_year(t).cast("string"), 4, "0"),
    "g": lambda t: _two(_iso_year(t) % 100),
}


def strftime(template: str, value: Column | str = "now", *modifiers: str, kind: str = "string") -> Column:
    """A constant template becomes one concatenation; an unknown directive gives NULL."""
    ts, parts = time_value(value, *modifiers, kind=kind), []
    for piece in re.findall(r"%.|%$|[^%]+", template, re.S):
        if piece[0] != "%":
            parts.append(F.lit(piece))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece[1:] in _DIRECTIVES:
            parts.append(_DIRECTIVES[piece[1:]](ts))
        else:
            return F.lit(None).cast("string")
    return F.when(ts.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def difference(a, b) -> str:
    """+YYYY-MM-DD HH:MM:SS.SSS from b to a: whole months first, then the rest in days and time."""
    sign, low, high = ("+", b, a) if a >= b else ("-", a, b)
    months = (high.year - low.year) * 12 + high.month - low.month

    def later(n: int):
        import calendar
        import datetime as dt

        year, month = divmod(low.year * 12 + low.month - 1 + n, 12)
        spare = low.day - calendar.monthrange(year, month + 1)[1]
        moved = low.replace(year=year, month=month + 1, day=min(low.day, calendar.monthrange(year, month + 1)[1]))
        return moved + dt.timedelta(days=max(0, spare))

    while months and later(months) > high:
        months -= 1
    rest = high - later(months)
    ms = rest.seconds * 1000 + rest.microseconds // 1000
    return f"{sign}{months // 12:04d}-{months % 12:02d}-{rest.days:02d} {ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def timediff(a: Column, b: Column, kind: str = "string") -> Column:

    @F.pandas_udf("string")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(p) or pd.isna(q) else difference(p.to_pydatetime(), q.to_pydatetime()) for p, q in zip(x, y)])

    return apply(time_value(a, kind=kind), time_value(b, kind=kind))
