"""Math functions of the dialect: NULL outside the domain, log is to base 10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.operators import lit


def _d(x: Column | float) -> Column:
    return lit(x).cast("double")


def _within(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def abs_(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x.try_cast("double")).cast("int")


def round_(x: Column, n: int = 0) -> Column:
    """Half away from zero on the exact binary value, as a real. The product's rounding error decides apparent ties."""
    x, n = _d(x), min(max(n, 0), 30)
    if n > 15:
        return x
    scale, a = 10.0**n, F.abs(_d(x))
    p = a * scale
    split = a * 134217729.0
    high = split - (split - a)
    s_high = 134217729.0 * scale - (134217729.0 * scale - scale)
    error = ((high * s_high - p) + high * (scale - s_high) + (a - high) * s_high) + (a - high) * (scale - s_high)
    base = F.floor(p).cast("double")
    part = p - base
    up = F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1.0).otherwise(0.0)
    value = F.signum(x) * (base + up) / scale
    return F.when(p >= 4503599627370496.0, x).otherwise(value)


def mod(x: Column, y: Column) -> Column:
    return _d(x) % F.nullif(_d(y), F.lit(0.0))


def ceil(x: Column, kind: str = "double") -> Column:
    return F.ceil(x).cast(kind)


ceiling = ceil


def floor(x: Column, kind: str = "double") -> Column:
    return F.floor(x).cast(kind)


def trunc(x: Column, kind: str = "double") -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(kind)


def pi() -> Column:
    return F.pi()


def sqrt(x: Column) -> Column:
    return _within(_d(x) >= 0, F.sqrt(_d(x)))


def power(x: Column, y: Column) -> Column:
    return F.pow(_d(x), _d(y))


pow_ = power


def exp(x: Column) -> Column:
    return F.exp(_d(x))


def ln(x: Column) -> Column:
    return F.ln(_d(x))


def log(a: Column, b: Column | None = None) -> Column:
    """log(x) to base 10; log(base, x), NULL for a base <= 0 or 1."""
    if b is None:
        return log10(a)
    base, x = _d(a), _d(b)
    return _within((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.ln(base))


def log10(x: Column) -> Column:
    return F.log10(_d(x))


def log2(x: Column) -> Column:
    return F.log2(_d(x))


def sin(x: Column) -> Column:
    return F.sin(_d(x))


def cos(x: Column) -> Column:
    return F.cos(_d(x))


def tan(x: Column) -> Column:
    return F.tan(_d(x))


def sinh(x: Column) -> Column:
    return F.sinh(_d(x))


def cosh(x: Column) -> Column:
    return F.cosh(_d(x))


def tanh(x: Column) -> Column:
    return F.tanh(_d(x))


def asin(x: Column) -> Column:
    return _within(_d(x).between(-1, 1), F.asin(_d(x)))


def acos(x: Column) -> Column:
    return _within(_d(x).between(-1, 1), F.acos(_d(x)))


def atan(x: Column) -> Column:
    return F.atan(_d(x))


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(_d(y), _d(x))


def asinh(x: Column) -> Column:
    return F.asinh(_d(x))


def acosh(x: Column) -> Column:
    return _within(_d(x) >= 1, F.acosh(_d(x)))


def atanh(x: Column) -> Column:
    return _within((_d(x) > -1) & (_d(x) < 1), F.atanh(_d(x)))


def degrees(x: Column) -> Column:
    return F.degrees(_d(x))


def radians(x: Column) -> Column:
    return F.radians(_d(x))


def random() -> Column:
    """A random 64-bit integer."""
    return F.xxhash64(F.rand(), F.rand())


def randomblob(n: int) -> Column:
    """n random bytes, at least one."""
    count = max(1, n)
    pieces = [F.hex(F.xxhash64(F.rand(), F.rand())) for _ in range(-(-count // 8))]
    return F.substring(F.unhex(F.concat(*(F.lpad(p, 16, "0") for p in pieces))), 1, count)
