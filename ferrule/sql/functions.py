"""The dialect's functions as Spark SQL text. A value is (text, type); types: int, real, text, bool, blob, any."""

from __future__ import annotations

import re
from collections.abc import Callable

from ferrule.functions import jsons, nulls

Value = tuple[str, str]
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(x: str) -> str:
    return f"translate(CAST({x} AS STRING), {_UP}, {_LOW})"


def text(v: Value) -> str:
    """A value as text; reals in plain notation for usual magnitudes."""
    return v[0] if v[1] == "text" else f"ferrule_text({v[0]})" if v[1] == "real" else f"CAST({v[0]} AS STRING)"


def _d(v: Value) -> str:
    return f"CAST({v[0]} AS DOUBLE)"


def _literal(v: Value) -> str:
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", v[0], re.S)
    if not m:
        raise NotImplementedError("this argument must be a text literal")
    return re.sub(r"\\(.)", r"\1", m[1])


def _substr(x: Value, y: Value, z: Value | None = None) -> str:
    s, n = text(x), f"length({text(x)})"
    if z is None:
        return f"CASE WHEN {y[0]} = 0 THEN {s} WHEN {y[0]} < 0 AND -({y[0]}) > {n} THEN {s} ELSE substr({s}, CAST({y[0]} AS INT)) END"
    at = f"(CASE WHEN {y[0]} > 0 THEN {y[0]} - 1 WHEN {y[0]} < 0 THEN {n} + {y[0]} ELSE -1 END)"
    low, high = f"CASE WHEN {z[0]} < 0 THEN {at} + {z[0]} ELSE {at} END", f"CASE WHEN {z[0]} < 0 THEN {at} ELSE {at} + {z[0]} END"
    return f"substr({s}, CAST(greatest({low}, 0) + 1 AS INT), CAST(greatest(least(greatest({high}, 0), {n}) - greatest({low}, 0), 0) AS INT))"


def cast(v: Value, declared: str) -> Value:
    d = declared.upper()
    if "INT" in d:
        if v[1] in ("text", "any"):
            digits = f"regexp_extract({text(v)}, '^[ \\\\t\\\\n]*([+-]?[0-9]+)', 1)"
            return f"CASE WHEN {v[0]} IS NOT NULL THEN coalesce(try_cast({digits} AS BIGINT), CASE WHEN {digits} = '' THEN 0 WHEN startswith({digits}, '-') THEN -9223372036854775807 - 1 ELSE 9223372036854775807 END) END", "int"
        if v[1] == "real":
            return f"CASE WHEN {v[0]} >= 9.223372036854775807E18D THEN 9223372036854775807 WHEN {v[0]} <= -9.223372036854775808E18D THEN -9223372036854775807 - 1 ELSE CAST({v[0]} AS BIGINT) END", "int"
        return f"CAST({v[0]} AS BIGINT)", "int"
    if any(w in d for w in ("CHAR", "CLOB", "TEXT")):
        return text(v), "text"
    if "BLOB" in d:
        return f"CAST({text(v)} AS BINARY)", "blob"
    if v[1] == "text":
        number = f"regexp_extract({v[0]}, '^[ \\\\t\\\\n]*([+-]?(?:[0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
        return f"CASE WHEN {v[0]} IS NOT NULL THEN coalesce(try_cast({number} AS DOUBLE), 0D) END", "real"
    return _d(v), "real"


def _domain(condition: str, call: str) -> Callable[..., Value]:
    return lambda x: (f"CASE WHEN {condition.format(_d(x))} THEN {call.format(_d(x))} END", "real")


def _strict(name: str) -> Callable[..., Value]:
    def build(*xs: Value) -> Value:
        kind = "text" if any(x[1] == "text" for x in xs) else "real" if any(x[1] == "real" for x in xs) else "int"
        return f"CASE WHEN {' AND '.join(f'{x[0]} IS NOT NULL' for x in xs)} THEN {name}({', '.join(x[0] for x in xs)}) END", kind

    return build


def _iif(*xs: Value) -> Value:
    pairs = [f"WHEN {truth(xs[k])} THEN {xs[k + 1][0]}" for k in range(0, len(xs) - 1, 2)]
    return f"CASE {' '.join(pairs)}{f' ELSE {xs[-1][0]}' if len(xs) % 2 else ''} END", xs[1][1]


def condition(v: Value) -> str:
    """A value as a condition."""
    return v[0] if v[1] in ("bool", "any") else f"({_d(v)} <> 0)" if v[1] != "text" else f"({cast(v, 'REAL')[0]} <> 0)"


def truth(v: Value) -> str:
    """A value as the condition of CASE and IIF: there any text is true but the empty one and '0'."""
    if v[1] in ("text", "blob"):
        return f"({v[0]} <> '' AND {v[0]} <> '0')" if v[1] == "text" else f"(octet_length({v[0]}) > 0)"
    return condition(v)


def quoted(v: Value) -> str:
    """A value as JSON, in the JVM."""
    if v[1] == "json":
        return f"coalesce({v[0]}, 'null')"
    if v[1] in ("int", "bool"):
        return f"coalesce(CAST({v[0]} AS STRING), 'null')"
    if v[1] == "real":
        return f"coalesce(ferrule_text({v[0]}), 'null')"
    whole = f"to_json(named_struct('v', {text(v)}))"
    return f"CASE WHEN {v[0]} IS NULL THEN 'null' ELSE substr({whole}, 6, length({whole}) - 6) END"


def _extreme(name: str) -> Callable[..., Value]:
    """Scalar min and max: numbers come before text and text before blobs; NULL if any is NULL."""
    rank = {"int": 0, "real": 0, "bool": 0, "any": 0, "text": 1, "json": 1, "time": 1, "blob": 2}

    def build(*xs: Value) -> Value:
        xs = tuple((f"CAST({x[0]} AS INT)", "int") if x[1] == "bool" else x for x in xs)
        best = (min if name == "least" else max)(rank[x[1]] for x in xs)
        own = [x for x in xs if rank[x[1]] == best]
        kind = own[0][1] if best else "real" if any(x[1] == "real" for x in own) else "int"
        value = f"{name}({', '.join(x[0] for x in own)})" if len(own) > 1 else own[0][0]
        return f"CASE WHEN {' AND '.join(f'{x[0]} IS NOT NULL' for x in xs)} THEN {value} END", kind

    return build


def _jsonb_extract(x: Value, p: Value) -> Value:
    if p[0].startswith("'") and "#" not in p[0]:
        return f"try_variant_get(parse_json({x[0]}), {p[0]})", "any"
    return f"parse_json({python('json_part')(x, p)[0]})", "any"


# Dates -----------------------------------------------------------------------------------------------------------

_DAY, _CLOCK, _ZONE = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?", "(?:Z|[+-][0-9]{2}:[0-9]{2})?"
_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def moment(args: tuple[Value, ...]) -> str:
    """A time value and its modifiers as a TIMESTAMP."""
    value, mods = args[0] if args else ("'now'", "text"), [_literal(a).strip().lower() for a in args[1:]]
    if value[1] in ("int", "real"):
        if mods[:1] not in (["unixepoch"], ["auto"]):
            return "CAST(NULL AS TIMESTAMP)"
        julian = f"timestamp_micros(CAST(round(({value[0]} - 2440587.5D) * 86400000) * 1000 AS BIGINT))"
        seconds = f"timestamp_micros(CAST(round({_d(value)} * 1000000) AS BIGINT))"
        ts = f"CASE WHEN {value[0]} BETWEEN 0 AND 5373484.499999D THEN {julian} ELSE {seconds} END" if mods.pop(0) == "auto" else seconds
    elif value[1] == "time":
        ts = f"CAST({value[0]} AS TIMESTAMP)"
    else:
        t = f"trim({text(value)})"
        ts = f"CASE WHEN lower({t}) = 'now' THEN current_timestamp() WHEN {t} RLIKE '^{_DAY}(?:[ T]{_CLOCK}{_ZONE})?$' THEN try_cast({t} AS TIMESTAMP) WHEN {t} RLIKE '^{_CLOCK}{_ZONE}$' THEN try_cast(concat('2000-01-01T', {t}) AS TIMESTAMP) END"
    for k, m in enumerate(mods):
        if m in ("subsec", "subsecond", "floor", "ceiling"):
            continue
        if f := re.fullmatch(r"start of (day|month|year)", m):
            ts = f"date_trunc('{f[1]}', {ts})"
        elif f := re.fullmatch(r"weekday ([0-6])", m):
            ts = f"timestamp_micros(unix_micros({ts}) + pmod({f[1]} - (dayofweek({ts}) - 1), 7) * 86400000000)"
        elif f := re.fullmatch(r"([+-]?[0-9]+(?:\.[0-9]+)?) (day|hour|minute|second)", m):
            ts = f"timestamp_micros(unix_micros({ts}) + {round(float(f[1]) * _MICROS[f[2]])})"
        elif f := re.fullmatch(r"([+-]?[0-9]+) (month|year)", m):
            first = f"add_months(trunc({ts}, 'month'), {int(f[1]) * (12 if f[2] == 'year' else 1)})"
            day = f"date_add({first}, dayofmonth({ts}) - 1)"
            day = f"least({day}, last_day({first}))" if mods[k + 1 : k + 2] == ["floor"] else day
            ts = f"timestamp_micros(unix_micros(CAST({day} AS TIMESTAMP)) + unix_micros({ts}) - unix_micros(date_trunc('day', {ts})))"
        else:
            return "CAST(NULL AS TIMESTAMP)"
    return ts


_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}
_PIECES = {
    "j": "lpad(dayofyear({0}), 3, '0')", "w": "CAST(dayofweek({0}) - 1 AS STRING)", "u": "CAST(weekday({0}) + 1 AS STRING)", "s": "CAST(unix_seconds({0}) AS STRING)", "V": "lpad(weekofyear({0}), 2, '0')",
    "p": "CASE WHEN hour({0}) < 12 THEN 'AM' ELSE 'PM' END", "P": "CASE WHEN hour({0}) < 12 THEN 'am' ELSE 'pm' END", "e": "lpad(dayofmonth({0}), 2, ' ')", "k": "lpad(hour({0}), 2, ' ')",
    "I": "lpad(pmod(hour({0}) + 11, 12) + 1, 2, '0')", "l": "lpad(pmod(hour({0}) + 11, 12) + 1, 2, ' ')", "J": "CAST(unix_micros({0}) / 86400000000D + 2440587.5D AS STRING)",
    "W": "lpad(floor((dayofyear({0}) + 6 - weekday({0})) / 7), 2, '0')", "U": "lpad(floor((dayofyear({0}) + 7 - dayofweek({0})) / 7), 2, '0')", "G": "CAST(year(date_add({0}, 3 - weekday({0}))) AS STRING)", "g": "lpad(year(date_add({0}, 3 - weekday({0}))) % 100, 2, '0')",
}


def strftime(template: Value, *args: Value) -> Value:
    ts, parts = moment(args), []
    for piece in re.findall(r"%.|%$|[^%]+", _literal(template), re.S):
        if piece[0] != "%":
            parts.append(quote(piece))
        elif piece == "%%":
            parts.append("'%'")
        elif piece[1:] in _FORMATS:
            parts.append(f"date_format({ts}, '{_FORMATS[piece[1:]]}')")
        elif piece[1:] in _PIECES:
            parts.append(_PIECES[piece[1:]].format(ts))
        else:
            return "CAST(NULL AS STRING)", "text"
    return f"concat({', '.join(parts)})" if parts else "''", "text"


def _formatted(pattern: str) -> Callable[..., Value]:
    return lambda *a: (f"date_format({moment(a)}, '{pattern}')", "text")


# Functions that run in Python, through one registered function for each result ------------------------------------


def python(name: str, kind: str = "text") -> Callable[..., Value]:
    spark = {"text": "STRING", "int": "BIGINT"}[kind]

    def build(*xs: Value) -> Value:
        kinds = "".join({"int": "i", "real": "r", "bool": "b", "blob": "x", "json": "j"}.get(x[1], "t") for x in xs)
        sent = ", ".join([quote(name), quote(kinds), *(f"CAST({x[0]} AS STRING)" for x in xs)])
        return f"CAST(ferrule_call({sent}) AS {spark})", "json" if name.startswith("json") and kind == "text" and name not in ("json_extract", "json_arrow_value", "json_type") else kind

    return build


_VALUES = {"BIGINT": "try_variant_get({0}, '$', 'string')", "STRING": "try_variant_get({0}, '$', 'string')", "BOOLEAN": "CAST(CAST(try_variant_get({0}, '$', 'boolean') AS INT) AS STRING)", "VOID": "CAST(NULL AS STRING)"}
_TEXTS = {"BIGINT": "to_json({0})", "STRING": "to_json({0})", "BOOLEAN": "to_json({0})", "VOID": "'null'"}
_TYPES = {"BIGINT": "'integer'", "STRING": "'text'", "BOOLEAN": "try_variant_get({0}, '$', 'string')", "VOID": "'null'", "DOUBLE": "'real'"}


def read(name: str, cells: dict[str, str]) -> Callable[..., Value]:
    """A function that reads one part of a JSON text: by VARIANT where the path is a plain literal and the part's type is
    one of cells; other rows go to Python, these send it a NULL."""
    slow = python(name)

    def build(x: Value, path: Value = ("'$'", "text"), *more: Value) -> Value:
        try:
            label = int(path[0]) if path[1] == "int" else _literal(path)
        except (NotImplementedError, ValueError):
            return slow(x, path, *more)
        bare = jsons._plain(jsons._arrow_path(label) if name.startswith("json_arrow") else str(label))
        if more or bare is None:
            return slow(x, path, *more)
        whole = f"try_parse_json({text(x)})"
        part = whole if bare == "$" else f"try_variant_get({whole}, {quote(bare)}, 'variant')"
        kind = f"schema_of_variant({part})"
        done = f"({whole} IS NOT NULL AND ({part} IS NULL OR {kind} IN ({', '.join(map(quote, cells))})))"
        cases = " ".join(f"WHEN {quote(k)} THEN {v.format(part)}" for k, v in cells.items())
        rest, result = slow((f"CASE WHEN NOT coalesce({done}, false) THEN {text(x)} END", x[1]), path)
        return f"CASE WHEN {done} THEN CASE {kind} {cases} END ELSE {rest} END", result

    return build


def _json_valid(x: Value, flags: Value = ("1", "int")) -> Value:
    if not flags[0].isdigit() or not int(flags[0]) & 3:
        return python("json_valid", "int")(x, flags)
    sure = f"(try_parse_json({text(x)}) IS NOT NULL)"
    return f"CASE WHEN {sure} THEN 1 ELSE {python('json_valid', 'int')((f'CASE WHEN NOT {sure} THEN {text(x)} END', x[1]), flags)[0]} END", "int"


def _json_length(x: Value, *path: Value) -> Value:
    if path:
        return python("json_array_length", "int")(x, *path)
    return f"CASE WHEN {x[0]} IS NOT NULL THEN CAST(coalesce(json_array_length({text(x)}), 0) AS BIGINT) END", "int"


_f = lambda template, kind: lambda *xs: (template.format(*(x[0] for x in xs)), kind)
_m = lambda name: lambda *xs: (f"{name}({', '.join(_d(x) for x in xs)})", "real")
_keep = lambda name: lambda x: (f"CAST({name}({x[0]}) AS {'BIGINT' if x[1] == 'int' else 'DOUBLE'})", x[1] if x[1] == "int" else "real")

FUNCTIONS: dict[str, Callable[..., Value]] = {
    "length": lambda x: (f"length({text(x) if x[1] != 'blob' else x[0]})", "int"), "octet_length": lambda x: (f"octet_length({text(x)})", "int"), "lower": lambda x: (fold(text(x)), "text"), "upper": lambda x: (f"translate({text(x)}, {_LOW}, {_UP})", "text"),
    "trim": lambda x, c=("' '", "text"): (f"trim(BOTH {c[0]} FROM {text(x)})", "text"), "ltrim": lambda x, c=("' '", "text"): (f"trim(LEADING {c[0]} FROM {text(x)})", "text"), "rtrim": lambda x, c=("' '", "text"): (f"trim(TRAILING {c[0]} FROM {text(x)})", "text"),
    "substr": lambda *a: (_substr(*a), "text"), "substring": lambda *a: (_substr(*a), "text"), "instr": lambda x, y: (f"locate({text(y)}, {text(x)})", "int"),
    "replace": lambda x, a, b: (f"CASE WHEN {text(a)} = '' THEN {text(x)} ELSE replace({text(x)}, {text(a)}, {text(b)}) END", "text"), "concat": lambda *xs: (f"concat_ws('', {', '.join(map(text, xs))})", "text"), "concat_ws": lambda *xs: (f"concat_ws({', '.join(map(text, xs))})", "text"),
    "hex": lambda x: (f"coalesce(hex(CAST({text(x) if x[1] != 'blob' else x[0]} AS BINARY)), '')", "text"), "unhex": lambda x, i=("''", "text"): (f"CASE WHEN length(translate({x[0]}, {i[0]}, '')) % 2 = 0 AND translate({x[0]}, {i[0]}, '') RLIKE '^[0-9A-Fa-f]*$' THEN unhex(translate({x[0]}, {i[0]}, '')) END", "blob"),
    "unicode": lambda x: (f"CASE WHEN {text(x)} <> '' THEN ascii({text(x)}) END", "int"), "char": lambda *xs: ("concat_ws('', " + ", ".join(f"decode(unhex(lpad(hex({x[0]}), 8, '0')), 'UTF-32')" for x in xs) + ")", "text"),
    "quote": lambda x: ((f"coalesce(concat('\\'', replace({x[0]}, '\\'', '\\'\\''), '\\''), 'NULL')" if x[1] == "text" else f"coalesce({text(x)}, 'NULL')"), "text"), "zeroblob": _f("unhex(repeat('00', CAST(greatest({0}, 0) AS INT)))", "blob"),
    "printf": python("printf"), "format": python("printf"), "unistr": python("unistr"), "unistr_quote": python("unistr_quote"),
    "coalesce": lambda *xs: (f"coalesce({', '.join(x[0] for x in xs)})", xs[0][1] if xs[0][1] != "any" else xs[1][1]), "ifnull": lambda x, y: (f"coalesce({x[0]}, {y[0]})", x[1] if x[1] != "any" else y[1]), "nullif": lambda x, y: (f"nullif({x[0]}, {y[0]})", x[1]),
    "iif": _iif, "if": _iif, "min": _extreme("least"), "max": _extreme("greatest"), "subtype": _f("0", "int"), "likely": lambda x: x, "unlikely": lambda x: x, "likelihood": lambda x, p: x,
    "typeof": lambda x: (f"CASE WHEN {x[0]} IS NULL THEN 'null' ELSE '{ {'int': 'integer', 'real': 'real', 'blob': 'blob', 'bool': 'integer'}.get(x[1], 'text') }' END", "text"),
    "abs": lambda x: (f"abs({x[0]})", x[1]), "sign": lambda x: (f"CAST(signum(try_cast({x[0]} AS DOUBLE)) AS INT)", "int"), "round": lambda x, n=("0", "int"): (f"ferrule_round({_d(x)}, CAST({n[0]} AS INT))", "real"), "mod": lambda x, y: (f"{_d(x)} % nullif({_d(y)}, 0D)", "real"),
    "ceil": _keep("ceil"), "ceiling": _keep("ceil"), "floor": _keep("floor"), "trunc": lambda x: (f"CASE WHEN {x[0]} < 0 THEN CAST(ceil({x[0]}) AS {'BIGINT' if x[1] == 'int' else 'DOUBLE'}) ELSE CAST(floor({x[0]}) AS {'BIGINT' if x[1] == 'int' else 'DOUBLE'}) END", x[1]), "pi": _f("pi()", "real"),
    "sqrt": _domain("{0} >= 0", "sqrt({0})"), "power": _m("pow"), "pow": _m("pow"), "exp": _m("exp"), "ln": _domain("{0} > 0", "ln({0})"), "log10": _domain("{0} > 0", "log10({0})"), "log2": _domain("{0} > 0", "log2({0})"),
    "log": lambda a, b=None: (_domain("{0} > 0", "log10({0})")(a) if b is None else (f"CASE WHEN {_d(a)} > 0 AND {_d(a)} <> 1 AND {_d(b)} > 0 THEN ln({_d(b)}) / ln({_d(a)}) END", "real")),
    **{n: _m(n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "atan2", "asinh", "degrees", "radians")}, "asin": _domain("{0} BETWEEN -1 AND 1", "asin({0})"), "acos": _domain("{0} BETWEEN -1 AND 1", "acos({0})"), "acosh": _domain("{0} >= 1", "acosh({0})"), "atanh": _domain("{0} > -1 AND {0} < 1", "atanh({0})"),
    "random": _f("xxhash64(rand(), rand())", "int"), "randomblob": _f("substr(unhex(repeat(hex(xxhash64(rand(), rand())), CAST({0} AS INT))), 1, greatest({0}, 1))", "blob"),
    "date": _formatted("yyyy-MM-dd"), "time": _formatted("HH:mm:ss"), "datetime": _formatted("yyyy-MM-dd HH:mm:ss"), "julianday": lambda *a: (f"unix_micros({moment(a)}) / 86400000000D + 2440587.5D", "real"), "unixepoch": lambda *a: (f"unix_seconds({moment(a)})", "int"), "strftime": strftime,
    "timediff": lambda a, b: python("timediff")((f"CAST({moment((a,))} AS STRING)", "text"), (f"CAST({moment((b,))} AS STRING)", "text")),
    **{n: python(n) for n in ("json", "json_pretty", "json_quote", "json_array", "json_object", "json_remove", "json_set", "json_insert", "json_replace", "json_patch")},
    "json_extract": read("json_extract", _VALUES), "json_type": read("json_type", _TYPES), "json_valid": _json_valid, "json_array_length": _json_length, "json_error_position": python("json_error_position", "int"),
    **{f"jsonb{n}": (lambda f: lambda *xs: (f"parse_json({f(*xs)[0]})", "any"))(python(f"json{n}")) for n in ("", "_array", "_object", "_remove", "_set", "_insert", "_replace", "_patch")}, "jsonb_extract": _jsonb_extract,
    "sqlite_version": _f(quote(nulls.VERSION), "text"), "sqlite_source_id": _f(quote(nulls.SOURCE_ID), "text"), "sqlite_compileoption_used": lambda x: (str(int(_literal(x).upper() in [o.split("=")[0] for o in nulls.COMPILE_OPTIONS])), "int"), "sqlite_log": _f("CAST(NULL AS STRING)", "text"),
    "sqlite_compileoption_get": lambda x: (quote(nulls.COMPILE_OPTIONS[int(x[0])]) if int(x[0]) < len(nulls.COMPILE_OPTIONS) else "CAST(NULL AS STRING)", "text"), "like": lambda p, x: (f"{fold(x[0])} LIKE {fold(p[0])}", "bool"),
}


def call(name: str, kinds: str, *args: str | None) -> str | None:
    """What ferrule_call does: a function of the dialect on Python values."""
    from datetime import datetime

    from ferrule.functions import dates, jsons, strings

    turn = {"i": int, "r": float, "b": lambda v: v == "true"}
    values = [None if a is None else turn.get(k, str)(a) for k, a in zip(kinds, args)]
    doc = lambda k, a, v: jsons.parse(a) if k == "j" and a is not None else jsons.model(v)
    docs = [doc(k, a, v) for k, a, v in zip(kinds, args, values)] if name in ("json_array", "json_object", "json_set", "json_insert", "json_replace", "json_quote") else []
    if name == "json_array":
        return jsons.dump(docs)
    if name == "json_object":
        return jsons.dump(jsons.Obj((values[k], docs[k + 1]) for k in range(0, len(values), 2)))
    if name == "json_quote":
        return jsons.dump(docs[0])
    if not values or values[0] is None:
        return "NULL" if name == "unistr_quote" else None
    if name == "printf":
        return strings.format_text(values[0], values[1:])
    if name == "unistr":
        return strings.decode_escapes(values[0])
    if name == "unistr_quote":
        return strings.quoted(values[0])
    if name == "timediff":
        return None if values[1] is None else dates.difference(*(datetime.fromisoformat(v) for v in values))
    if name in ("json_valid", "json_error_position"):
        try:
            jsons.parse(values[0], strict=name == "json_valid" and not (values[1] if len(values) > 1 else 1) & 2)
            return "1" if name == "json_valid" else "0"
        except jsons.JsonError as e:
            return "0" if name == "json_valid" else str(e.position)
    v = jsons.parse(values[0])
    if name in ("json_set", "json_insert", "json_replace"):
        for k in range(1, len(values), 2):
            v = jsons._put(v, jsons.path_steps(values[k]), docs[k + 1], name != "json_replace", name != "json_insert")
        return jsons.dump(v)
    if name == "json_remove":
        for p in values[1:]:
            v = jsons._delete(v, jsons.path_steps(p))
        return jsons.dump(v)
    if name == "json_patch":
        return None if values[1] is None else jsons.dump(jsons._merge(v, jsons.parse(values[1])))
    if name == "json_pretty":
        return jsons.dump(v, values[1] if len(values) > 1 else "    ")
    if name == "json":
        return jsons.dump(v)
    paths = [jsons._arrow_path(p) if name.startswith("json_arrow") else p for p in values[1:]] or ["$"]
    found = [jsons.get(v, p) for p in paths]
    if name == "json_extract" and len(paths) > 1:
        return jsons.dump([None if f is jsons._MISSING else f for f in found])
    if found[0] is jsons._MISSING:
        return None
    return {"json_extract": jsons.as_value, "json_part": jsons.dump, "json_arrow_value": jsons.as_value, "json_arrow": jsons.dump, "json_type": jsons.kind_of, "json_array_length": lambda f: str(len(f)) if jsons.kind_of(f) == "array" else "0"}[name](found[0])


#: Functions that Catalyst inlines: reals in plain notation, and rounding of the exact binary value, half away from zero
#: (the product's rounding error, found by splitting both factors in halves, decides apparent ties).
SQL_FUNCTIONS = {
    "ferrule_plain(s STRING) RETURNS STRING": r"""
        CASE WHEN s RLIKE '[.]0+$' OR NOT contains(s, '.') THEN concat(regexp_replace(s, '[.]0+$', ''), '.0') ELSE regexp_replace(s, '0+$', '') END""",
    "ferrule_text(x DOUBLE) RETURNS STRING": """
        CASE WHEN x IS NULL THEN NULL
             WHEN CAST(x AS STRING) = 'Infinity' THEN 'Inf' WHEN CAST(x AS STRING) = '-Infinity' THEN '-Inf'
             WHEN NOT contains(CAST(x AS STRING), 'E') THEN CAST(x AS STRING)
             WHEN abs(x) < 1E15D AND abs(x) > 1E-4D THEN ferrule_plain(CAST(try_cast(CAST(x AS STRING) AS DECIMAL(38, 18)) AS STRING))
             WHEN abs(x) < 1E38D AND abs(x) >= 1E15D THEN ferrule_plain(CAST(try_cast(CAST(x AS STRING) AS DECIMAL(38, 0)) AS STRING))
             WHEN abs(x) <= 1E-4D THEN ferrule_plain(CAST(try_cast(CAST(x AS STRING) AS DECIMAL(38, 36)) AS STRING))
             ELSE CAST(x AS STRING) END""",
    "ferrule_half(a DOUBLE) RETURNS DOUBLE": "a * 134217729D - (a * 134217729D - a)",
    "ferrule_error(a DOUBLE, b DOUBLE) RETURNS DOUBLE": """
        ((ferrule_half(a) * ferrule_half(b) - a * b) + ferrule_half(a) * (b - ferrule_half(b)) + (a - ferrule_half(a)) * ferrule_half(b))
        + (a - ferrule_half(a)) * (b - ferrule_half(b))""",
    "ferrule_up(a DOUBLE, scale DOUBLE) RETURNS DOUBLE": """
        CASE WHEN a * scale >= 4503599627370496D THEN a
             WHEN a * scale - floor(a * scale) > 0.5D OR (a * scale - floor(a * scale) = 0.5D AND ferrule_error(a, scale) >= 0)
             THEN (floor(a * scale) + 1D) / scale ELSE floor(a * scale) / scale END""",
    "ferrule_round(x DOUBLE, n INT) RETURNS DOUBLE": """
        CASE WHEN n > 15 THEN x ELSE signum(x) * ferrule_up(abs(x), power(10D, greatest(n, 0))) END""",
}


def register(spark) -> None:
    from pyspark.sql import functions as F

    spark.udf.register("ferrule_call", F.udf(call, "string", useArrow=True))
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
