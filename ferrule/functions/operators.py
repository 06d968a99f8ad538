"""Dialect-exact scalar operators as Column expressions. All stay inside Catalyst; none raises on data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LONG, MIN_LONG = 2**63 - 1, -(2**63)
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def lit(x: object) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


# Arithmetic ------------------------------------------------------------------------------------------------------


def _promoting(name: str, a: Column, b: Column, real: Column) -> Column:
    return F.coalesce(F.call_function(f"try_{name}", a, b).cast("double"), real)


def add(a: Column, b: Column) -> Column:
    """a + b of integers; DOUBLE, so that an overflow becomes a real number instead of an error."""
    return _promoting("add", a, b, a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return _promoting("subtract", a, b, a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return _promoting("multiply", a, b, a.cast("double") * b.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """a / b of two integers: truncated, NULL for b = 0."""
    return F.call_function("div", lit(a), F.nullif(lit(b), F.lit(0)))


def real_div(a: Column, b: Column) -> Column:
    """a / b if either is real; NULL for b = 0."""
    return lit(a).cast("double") / F.nullif(lit(b).cast("double"), F.lit(0.0))


def mod(a: Column, b: Column) -> Column:
    """a % b, both cut to integers first, sign of a, NULL for b = 0."""
    return lit(a).cast("long") % F.nullif(lit(b).cast("long"), F.lit(0).cast("long"))


def shift_left(x: Column, n: Column) -> Column:
    """x << n: 64 and more clear all bits, a negative n shifts right."""
    x, n = lit(x).cast("long"), lit(n).cast("int")
    left = F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, n))
    return F.when(n < 0, _right(x, -n)).otherwise(left)


def _right(x: Column, n: Column) -> Column:
    gone = F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    return F.when(n >= 64, gone).otherwise(F.call_function("shiftright", x, n))


def shift_right(x: Column, n: Column) -> Column:
    """x >> n, arithmetic: 64 and more leave 0 or -1, a negative n shifts left."""
    x, n = lit(x).cast("long"), lit(n).cast("int")
    left = F.when(-n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, -n))
    return F.when(n < 0, left).otherwise(_right(x, n))


def concat(*parts: Column) -> Column:
    """a || b: NULL if any is NULL; reals in plain notation. Pass reals through real_text."""
    return F.concat(*(lit(p).cast("string") for p in parts))


# Predicates ------------------------------------------------------------------------------------------------------


def truthy(x: Column) -> Column:
    """A number as a condition (three-valued)."""
    return lit(x).cast("double") != 0


def is_true(x: Column) -> Column:
    return F.coalesce(truthy(x), F.lit(False))


def is_false(x: Column) -> Column:
    return F.coalesce(~truthy(x), F.lit(False))


def is_distinct(a: Column, b: Column) -> Column:
    return ~lit(a).eqNullSafe(lit(b))


def is_in(x: Column, values: list) -> Column:
    """x IN (...): false for an empty list, else three-valued."""
    return x.isin(*[v for v in values if v is not None]) | (F.lit(None).cast("boolean") if None in values else F.lit(False)) if values else F.lit(False)


def row_compare(left: list[Column], op: str, right: list[Column]) -> Column:
    """(a, b) op (c, d), compared from the left, three-valued."""
    pairs = [(lit(a), lit(b)) for a, b in zip(left, right, strict=True)]
    equal = [a == b for a, b in pairs]
    if op in ("=", "<>"):
        every = equal[0]
        for e in equal[1:]:
            every = every & e
        return every if op == "=" else ~every
    a, b = pairs[-1]
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    for (a, b), e in zip(reversed(pairs[:-1]), reversed(equal[:-1])):
        out = (a < b if op[0] == "<" else a > b) | (e & out)
    return out


def fold(x: Column) -> Column:
    """A-Z as a-z; other letters as they are."""
    return F.translate(lit(x).cast("string"), UPPER, LOWER)


def like(x: Column, pattern: str, escape: str | None = None, case_sensitive: bool = False) -> Column:
    """x LIKE pattern [ESCAPE c]: folds ASCII case unless case_sensitive; without ESCAPE no character escapes."""
    if escape is not None and len(escape) != 1:
        raise ValueError("ESCAPE takes one character")
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape:
            at += 1
            if at == len(pattern):
                return F.when(x.isNotNull(), F.lit(False))  # an escape that escapes nothing matches nothing
            c = pattern[at]
            out.append(f"\\{c}" if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        at += 1
    text = "".join(out)
    if case_sensitive:
        return lit(x).cast("string").like(text)
    return fold(x).like(text.translate(str.maketrans(UPPER, LOWER)))


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """A [...] of GLOB or REGEXP that begins at a place, as a Java class, and the place after it."""
    end = at + 1
    negated = pattern[end : end + 1] == "^"
    end += negated
    begin = end
    if pattern[end : end + 1] == "]":
        end += 1
    while end < len(pattern) and pattern[end] != "]":
        end += 1
    if end == len(pattern):
        return None
    inner = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[begin:end])
    return f"[{'^' * negated}{inner}]", end + 1


def glob_regex(pattern: str) -> str | None:
    """GLOB as an anchored Java regex; None if it can't match."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            found = _class(pattern, at)
            if not found:
                return None
            out.append(found[0])
            at = found[1]
            continue
        out.append({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w\s])", r"\\\1", c))
        at += 1
    return f"(?s)^{''.join(out)}$"


def glob(x: Column, pattern: str) -> Column:
    """x GLOB pattern: case-sensitive, whole text. A plain prefix becomes a filter that scans can push down."""
    x = lit(x).cast("string")
    if re.fullmatch(r"[^*?\[]+\*", pattern):
        return x.startswith(pattern[:-1])
    regex = glob_regex(pattern)
    return x.rlike(regex) if regex else F.when(x.isNotNull(), F.lit(False))


def regexp(x: Column, pattern: str) -> Column:
    """x REGEXP pattern with ^ $ . * and [...] only; other signs stand for themselves."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            found = _class(pattern, at)
            if not found:
                raise ValueError("unclosed [ in REGEXP pattern")
            out.append(found[0])
            at = found[1]
            continue
        special = c in ".*" or (c == "^" and at == 0) or (c == "$" and at == len(pattern) - 1)
        out.append(c if special else re.sub(r"([^\w\s])", r"\\\1", c))
        at += 1
    return lit(x).cast("string").rlike(f"(?s){''.join(out)}")


def match(*_: object) -> Column:
    raise ValueError("unable to use function MATCH in the requested context")


# Casts -----------------------------------------------------------------------------------------------------------


def cast_integer(x: Column, kind: str = "string") -> Column:
    """CAST(x AS INTEGER). kind: x's type (string, double, or other). Text: its numeric beginning, else 0; saturates."""
    if kind == "string":
        digits = F.regexp_extract(x, r"^[ \t\n\r\f]*([+-]?[0-9]+)", 1)
        parsed = F.coalesce(digits.try_cast("long"), F.when(digits.startswith("-"), F.lit(MIN_LONG)).otherwise(F.lit(MAX_LONG)))
        return F.when(x.isNotNull(), F.when(digits == "", F.lit(0).cast("long")).otherwise(parsed))
    if kind == "double":
        return F.when(x >= float(MAX_LONG), F.lit(MAX_LONG)).when(x <= float(MIN_LONG), F.lit(MIN_LONG)).when(F.isnan(x), F.lit(0).cast("long")).otherwise(x.cast("long"))
    return x.cast("long")


def cast_real(x: Column, kind: str = "string") -> Column:
    """CAST(x AS REAL)."""
    if kind != "string":
        return x.cast("double")
    number = F.regexp_extract(x, rf"^[ \t\n\r\f]*({_NUMBER})", 1)
    return F.when(x.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def cast_text(x: Column, kind: str = "other") -> Column:
    """CAST(x AS TEXT); kind "double" for reals."""
    return real_text(x) if kind == "double" else x.cast("string")


def cast_blob(x: Column, kind: str = "other") -> Column:
    return cast_text(x, kind).cast("binary")


def real_text(x: Column) -> Column:
    """A real as text: shortest digits, plain notation up to 10^38, with .0 if whole."""
    text = x.cast("string")
    small = text.try_cast("decimal(38,18)").cast("string")
    plain = F.when(~text.contains("E"), text).when(F.abs(x) < 1e15, small).otherwise(F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text))
    short = F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1")
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).when(~short.contains("."), F.concat(short, F.lit(".0"))).otherwise(short)


def affinity(declared: str) -> str:
    """The Spark type of a declared column type."""
    d = declared.upper()
    if not d or "BLOB" in d:
        return "binary" if d else "variant"
    for words, kind in ((("INT",), "bigint"), (("CHAR", "CLOB", "TEXT"), "string"), (("BOOL",), "boolean")):
        if any(w in d for w in words):
            return kind
    return "double"


def collate(x: Column, name: str) -> Column:
    """x with BINARY, NOCASE (ASCII) or RTRIM comparison, as a key to compare, group or sort by."""
    name = name.upper()
    if name == "NOCASE":
        return fold(x)
    if name == "RTRIM":
        return F.regexp_replace(x, " +$", "")
    if name == "BINARY":
        return x
    raise ValueError(f"no such collation sequence: {name}")
