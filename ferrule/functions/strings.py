"""String and blob functions of the dialect."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.operators import LOWER, UPPER, fold, lit, real_text


def length(x: Column) -> Column:
    """Characters of a text up to its first NUL, bytes of a blob."""
    return F.length(F.substring_index(x, "\x00", 1))


def octet_length(x: Column) -> Column:
    return F.octet_length(x)


def lower(x: Column) -> Column:
    return fold(x)


def upper(x: Column) -> Column:
    return F.translate(lit(x).cast("string"), LOWER, UPPER)


def trim(x: Column, chars: str = " ") -> Column:
    return F.trim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def substr(x: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """From start (1 is the first, negative from the end; 0 uses up one of count); a negative count takes the
    characters before start."""
    y, n = lit(start).cast("long"), F.length(x).cast("long")
    if count is None:
        begin = F.when(y > 0, y - 1).when(y < 0, F.greatest(n + y, F.lit(0))).otherwise(F.lit(0))
        return F.substring(x, (begin + 1).cast("int"), n.cast("int"))
    z = lit(count).cast("long")
    at = F.when(y > 0, y - 1).when(y < 0, n + y).otherwise(F.lit(-1))  # may lie before the text
    low, high = F.when(z < 0, at + z).otherwise(at), F.when(z < 0, at).otherwise(at + z)
    low, high = F.greatest(low, F.lit(0)), F.least(F.greatest(high, F.lit(0)), n)
    known = y.isNotNull() & z.isNotNull() & x.isNotNull()
    return F.when(known, F.substring(x, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))


def instr(x: Column, needle: Column | str) -> Column:
    """The 1-based place of the first needle, 0 without; an empty needle is at 1."""
    return F.locate(needle, x) if isinstance(needle, str) else F.call_function("locate", needle, x)


def replace(x: Column, old: Column | str, new: Column | str) -> Column:
    old = lit(old)
    return F.when(old == "", F.when(lit(new).isNotNull(), x)).otherwise(F.replace(x, old, lit(new)))


def concat(*parts: Column) -> Column:
    """NULLs are skipped; never NULL."""
    return F.concat_ws("", *(lit(p).cast("string") for p in parts))


def concat_ws(separator: Column | str, *parts: Column) -> Column:
    return F.call_function("concat_ws", lit(separator), *(lit(p).cast("string") for p in parts))


def hex_(x: Column, kind: str = "other") -> Column:
    """Hex of the bytes of the value's text; '' for NULL. kind: double or binary if x is."""
    data = x if kind == "binary" else (real_text(x) if kind == "double" else x.cast("string")).cast("binary")
    return F.coalesce(F.hex(data), F.lit(""))


def unhex(x: Column, ignore: str = "") -> Column:
    digits = F.translate(x, ignore, "") if ignore else x
    return F.when((F.length(digits) % 2 == 0) & digits.rlike("^[0-9A-Fa-f]*$"), F.unhex(digits))


def unicode(x: Column) -> Column:
    return F.when(x != "", F.ascii(x).cast("long"))


def char(*codes: Column | int) -> Column:
    """Text of code points; NULLs skipped, invalid ones U+FFFD."""
    parts = []
    for code in codes:
        c = lit(code).cast("long")
        valid = c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        point = F.when(valid, c).otherwise(F.lit(0xFFFD))
        parts.append(F.when(c.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")))
    return F.concat_ws("", *parts)


def quote(x: Column, kind: str = "string") -> Column:
    """An SQL literal. kind: string, double, binary or other."""
    if kind == "string":
        text = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        text = real_text(x) if kind == "double" else x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def zeroblob(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(lit(n).cast("int"), F.lit(0))))


# Formats ---------------------------------------------------------------------------------------------------------


def format_text(template: str, args: list) -> str:
    """The dialect's printf on Python values: flags - + space , 0 # !, specs d i u f e E g G x X o p c s z q Q w n r %."""
    out, at, k = [], 0, 0

    def take():
        nonlocal k
        k += 1
        return args[k - 1] if k <= len(args) else None

    while at < len(template):
        c = template[at]
        if c != "%":
            out.append(c)
            at += 1
            continue
        at += 1
        flags = ""
        while at < len(template) and template[at] in "-+ ,0#!":
            flags += template[at]
            at += 1
        sizes: list[int | None] = [None, None]
        for which in (0, 1):
            if which and template[at : at + 1] != ".":
                break
            at += which
            if template[at : at + 1] == "*":
                sizes[which] = int(take() or 0)
                at += 1
            else:
                begin = at
                while at < len(template) and template[at].isdigit():
                    at += 1
                if at > begin or which:
                    sizes[which] = int(template[begin:at] or 0)
        while template[at : at + 1] == "l":
            at += 1
        spec = template[at : at + 1]
        at += 1
        width, precision = sizes
        if width is not None and width < 0:
            flags, width = flags + "-", -width
        out.append(_pad(_convert(spec, flags, precision, take), flags, width, spec))
    return "".join(out)


def _int(v: object) -> int:
    try:
        return int(float(v)) if not isinstance(v, int) else v  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0


def _real(v: object) -> float:
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0


def _plain(v: object) -> str:
    return "" if v is None else v.decode("utf-8", "replace") if isinstance(v, (bytes, bytearray)) else str(v)


def _convert(spec: str, flags: str, precision: int | None, take) -> str:
    sign = "+" if "+" in flags else " " if " " in flags else ""
    if spec == "%":
        return "%"
    if spec == "n":
        return ""
    if spec in "di":
        n = _int(take())
        digits = f"{abs(n):,}" if "," in flags else str(abs(n))
        return ("-" if n < 0 else sign) + digits.rjust(precision or 0, "0")
    if spec == "u":
        return str(_int(take()) % 2**64).rjust(precision or 0, "0")
    if spec in "xXop":
        n = _int(take()) % 2**64
        digits = format(n, "o" if spec == "o" else "X" if spec in "Xp" else "x")
        return (("0" if spec == "o" else "0x") if "#" in flags and n else "") + digits.rjust(precision or 0, "0")
    if spec in "feEgG":
        x = _real(take())
        p = 6 if precision is None else precision
        body = format(abs(x), f"{'#' if '#' in flags else ''}{',' if ',' in flags and spec == 'f' else ''}.{p or (1 if spec in 'gG' else 0)}{spec}")
        if "!" in flags and "." not in body and spec != "e":
            body += ".0"
        return ("-" if x < 0 else sign) + body
    if spec == "c":
        return _plain(take())[:1] * max(1, precision or 1)
    if spec in "szqQw":
        v = take()
        text = _plain(v)
        if precision is not None:
            text = text[:precision]
        if spec in "qQ":
            text = ("(NULL)" if spec == "q" else "NULL") if v is None else text.replace("'", "''")
            return f"'{text}'" if spec == "Q" and v is not None else text
        return text.replace('"', '""') if spec == "w" else text
    if spec == "r":
        n = _int(take())
        tail = "th" if 10 <= abs(n) % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(abs(n) % 10, "th")
        return f"{n}{tail}"
    return ""


def _pad(text: str, flags: str, width: int | None, spec: str) -> str:
    if width is None or len(text) >= width:
        return text
    if "-" in flags:
        return text.ljust(width)
    if "0" in flags and spec in "diufeEgGxXo":
        lead = 1 if text[:1] in "+- " else 0
        return text[:lead] + text[lead:].rjust(width - lead, "0")
    return text.rjust(width)


def printf(template: str, *args: Column) -> Column:
    """printf / format. Simple templates of %d and %s go to the JVM; the rest to an Arrow-batched function."""

    specs = re.findall(r"%[^A-Za-z%]*[A-Za-z%]", template)
    if all(s in ("%d", "%s", "%%") for s in specs) and len([s for s in specs if s != "%%"]) == len(args):
        sent = [F.coalesce(lit(a).cast("long"), F.lit(0).cast("long")) if s == "%d" else F.coalesce(lit(a).cast("string"), F.lit("")) for s, a in zip([s for s in specs if s != "%%"], args)]
        return F.format_string(template, *sent)

    @F.pandas_udf("string")
    def apply(*columns: pd.Series) -> pd.Series:
        rows = zip(*([None if v is None or v != v else v for v in c] for c in columns))
        return pd.Series([format_text(template, list(r)) for r in rows])

    return apply(*(lit(a) for a in args)) if args else F.lit(format_text(template, []))


def decode_escapes(text: str) -> str:
    r"""unistr: \XXXX, \uXXXX, \+XXXXXX, \UXXXXXXXX and \\."""

    def one(m: re.Match) -> str:
        if m[0] == "\\\\":
            return "\\"
        return chr(int(next(g for g in m.groups() if g), 16))

    out = re.sub(r"\\\\|\\([0-9A-Fa-f]{4})|\\u([0-9A-Fa-f]{4})|\\\+([0-9A-Fa-f]{6})|\\U([0-9A-Fa-f]{8})", one, text)
    if re.search(r"(?<!\\)(?:\\\\)*\\(?![\\0-9A-Fa-f+uU])", text):
        raise ValueError("invalid Unicode escape")
    return out


def unistr(x: Column) -> Column:

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else decode_escapes(v))

    return apply(x)


def quoted(v: str) -> str:
    """A literal; with control characters, as unistr('...')."""
    body = v.replace("'", "''")
    if any(ord(c) < 32 for c in v):
        return "unistr('" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else "\\\\" if c == "\\" else c for c in body) + "')"
    return f"'{body}'"


def unistr_quote(x: Column) -> Column:
    """A literal like quote(); with control characters, as unistr('...')."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: "NULL" if v is None else quoted(v), na_action=None)

    return apply(x)
