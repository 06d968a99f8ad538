"""NULL, conditional, type and session functions of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.operators import lit

#: The dialect's version and its build options.
VERSION, SOURCE_ID = "3.46.0", "2024-05-23 13:25:27"
COMPILE_OPTIONS = ("ENABLE_JSON1", "ENABLE_MATH_FUNCTIONS", "THREADSAFE=1")


def coalesce(*xs: Column) -> Column:
    if len(xs) < 2:
        raise ValueError("coalesce takes two arguments or more")
    return F.coalesce(*(lit(x) for x in xs))


def ifnull(x: Column, y: Column) -> Column:
    return F.ifnull(lit(x), lit(y))


def nullif(x: Column, y: Column) -> Column:
    return F.nullif(lit(x), lit(y))


def iif(*args: Column) -> Column:
    """iif(c, a[, c2, a2 ...][, default])."""
    if len(args) < 2:
        raise ValueError("iif takes two arguments or more")
    out = F.when(F.coalesce(args[0], F.lit(False)), lit(args[1]))
    for k in range(2, len(args) - 1, 2):
        out = out.when(F.coalesce(args[k], F.lit(False)), lit(args[k + 1]))
    return out.otherwise(lit(args[-1])) if len(args) % 2 else out


if_ = iif


def case(base: Column | None, whens: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE [base] WHEN ... THEN ... [ELSE ...] END."""
    out = None
    for when, then in whens:
        test = lit(when) if base is None else lit(base) == lit(when)
        out = F.when(test, lit(then)) if out is None else out.when(test, lit(then))
    return out if default is None else out.otherwise(lit(default))


def _strict(function, xs: tuple[Column, ...]) -> Column:
    known = lit(xs[0]).isNotNull()
    for x in xs[1:]:
        known = known & lit(x).isNotNull()
    return F.when(known, function(*(lit(x) for x in xs)))


def min_(*xs: Column) -> Column:
    """Scalar min: NULL if any is NULL."""
    return _strict(F.least, xs)


def max_(*xs: Column) -> Column:
    return _strict(F.greatest, xs)


def typeof(x: Column, kind: str) -> Column:
    """The storage class; kind: x's Spark type, e.g. from df.dtypes."""
    names = {"string": "text", "binary": "blob", "double": "real", "float": "real"}
    return F.when(x.isNull(), "null").otherwise(names.get(kind, "real" if kind.startswith("decimal") else "integer"))


def subtype(x: Column) -> Column:
    return F.lit(0)


def likely(x: Column) -> Column:
    return x


unlikely = likely


def likelihood(x: Column, p: float) -> Column:
    if not isinstance(p, float) or not 0 <= p <= 1:
        raise ValueError("second argument to likelihood() must be a constant between 0.0 and 1.0")
    return x


def unknown(*_: Column) -> Column:
    raise ValueError("unknown() has no value")


def sqlite_version() -> Column:
    return F.lit(VERSION)


def sqlite_source_id() -> Column:
    return F.lit(SOURCE_ID)


def sqlite_compileoption_used(name: str) -> Column:
    return F.lit(int(any(o.split("=")[0] == name.upper().removeprefix("SQLITE_") for o in COMPILE_OPTIONS)))


def sqlite_compileoption_get(n: int) -> Column:
    return F.lit(COMPILE_OPTIONS[n] if 0 <= n < len(COMPILE_OPTIONS) else None).cast("string")


def sqlite_log(code: Column, message: Column) -> Column:
    return F.lit(None).cast("string")
