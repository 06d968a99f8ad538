"""JSON functions of the dialect. JSON is text; JSONB is Spark's VARIANT.

Reads of one constant path, types, validity, array lengths and the building of arrays and objects are built-in
expressions: the text is parsed into a VARIANT, and only rows that need more (JSON5, duplicate keys, numbers whose text
counts, containers, whose keys a VARIANT sorts) go to Python; the others send it a NULL. Mutation, error positions and
several paths run in Arrow-batched functions over a small document model:
objects are lists of pairs, so duplicate keys and their order survive; numbers keep their text.
"""

from __future__ import annotations

import json as _json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.operators import lit


class JsonError(ValueError):
    """Malformed JSON; position is 1-based."""

    def __init__(self, position: int) -> None:
        super().__init__("malformed JSON")
        self.position = position


class Number(str):
    """A number as it stands in the text."""


class Obj(list):
    """Pairs of an object, in order."""


_SPACE = re.compile(r"(?:[\s﻿]|//[^\n]*|/\*.*?\*/)*", re.S)
_NUM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_NUM5 = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/", "'": "'", "v": "\v", "0": "\0", "\n": ""}


def _refuse(word: str) -> None:
    raise ValueError(word)


#: Strict JSON by the standard library's scanner, into the document model.
_DECODER = _json.JSONDecoder(object_pairs_hook=Obj, parse_int=Number, parse_float=Number, parse_constant=_refuse)


def parse(text: str, strict: bool = False) -> Any:
    """The document model of a text; JSON5 is understood unless strict."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return _parse(text, strict)


def _parse(text: str, strict: bool) -> Any:
    """What is no strict JSON: JSON5, or the place of the error."""
    at = 0

    def space() -> None:
        nonlocal at
        at = re.compile(r"[ \t\n\r]*").match(text, at).end() if strict else _SPACE.match(text, at).end()

    def fail() -> JsonError:
        return JsonError(at + 1)

    def string() -> str:
        nonlocal at
        mark, out = text[at], []
        at += 1
        while True:
            if at >= len(text):
                raise fail()
            c = text[at]
            if c == mark:
                at += 1
                return "".join(out)
            if c == "\\":
                e = text[at + 1 : at + 2]
                if e in ("u", "x"):
                    width = 4 if e == "u" else 2
                    digits = text[at + 2 : at + 2 + width]
                    if not re.fullmatch(f"[0-9a-fA-F]{{{width}}}", digits) or (strict and e == "x"):
                        raise fail()
                    out.append(chr(int(digits, 16)))
                    at += 2 + width
                    continue
                if e not in _ESCAPES or not e or (strict and e in "'v0\n"):
                    raise fail()
                out.append(_ESCAPES[e])
                at += 2
                continue
            if ord(c) < 32 and (strict or c == "\n"):
                raise fail()
            out.append(c)
            at += 1

    def value() -> Any:
        nonlocal at
        space()
        c = text[at : at + 1]
        if c == "{":
            at += 1
            out = Obj()
            space()
            while text[at : at + 1] != "}":
                if text[at : at + 1] == '"' or (not strict and text[at : at + 1] == "'"):
                    key = string()
                elif not strict and (m := _NAME.match(text, at)):
                    key, at = m[0], m.end()
                else:
                    raise fail()
                space()
                if text[at : at + 1] != ":":
                    raise fail()
                at += 1
                out.append((key, value()))
                space()
                if text[at : at + 1] == ",":
                    at += 1
                    space()
                    if text[at : at + 1] == "}" and strict:
                        raise fail()
                elif text[at : at + 1] != "}":
                    raise fail()
            at += 1
            return out
        if c == "[":
            at += 1
            items: list = []
            space()
            while text[at : at + 1] != "]":
                items.append(value())
                space()
                if text[at : at + 1] == ",":
                    at += 1
                    space()
                    if text[at : at + 1] == "]" and strict:
                        raise fail()
                elif text[at : at + 1] != "]":
                    raise fail()
            at += 1
            return items
        if c == '"' or (c == "'" and not strict):
            return string()
        for word, v in (("true", True), ("false", False), ("null", None)):
            if text.startswith(word, at):
                at += len(word)
                return v
        m = (_NUM if strict else _NUM5).match(text, at)
        if not m or not c:
            raise fail()
        at = m.end()
        return Number(m[0] if _NUM.fullmatch(m[0]) else _canonical(m[0]))

    out = value()
    space()
    if at < len(text):
        raise fail()
    return out


def _canonical(n: str) -> str:
    """A JSON5 number in plain JSON."""
    body = n.lstrip("+")
    sign, digits = ("-", body[1:]) if body.startswith("-") else ("", body)
    if digits[:2].lower() == "0x":
        return sign + str(int(digits, 16))
    if digits == "Infinity":
        return f"{sign}9.0e+999"
    if digits == "NaN":
        return "null"
    whole, _, tail = digits.partition(".")
    if "." not in digits:
        return sign + (whole.lstrip("0") or "0")
    if not tail or not tail[0].isdigit():
        tail = "0" + tail
    return f"{sign}{whole or '0'}.{tail}"


def dump(v: Any, indent: str | None = None, level: int = 0) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, str):
        return _json.dumps(v, ensure_ascii=False)
    if isinstance(v, (int, float)):
        return repr(v) if not isinstance(v, float) or v == v else "null"
    items = [f"{_json.dumps(k, ensure_ascii=False)}:{' ' if indent is not None else ''}{dump(x, indent, level + 1)}" for k, x in v] if isinstance(v, Obj) else [dump(x, indent, level + 1) for x in v]
    a, b = "{}" if isinstance(v, Obj) else "[]"
    if not items or indent is None:
        return a + ",".join(items) + b
    inner = "\n" + indent * (level + 1)
    return a + inner + f",{inner}".join(items) + "\n" + indent * level + b


_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(?:(#)(?:-([0-9]+))?|([0-9]+))\]')


def path_steps(path: str) -> list[str | int | tuple[str, int]]:
    """Steps of $.key, ."quoted", [n], [#-n] (as ("#", n)) and [#] (as ("#", 0), one past the end)."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path!r}")
    at, out = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path!r}")
        quoted, plain, end, back, index = m.groups()
        out.append(("#", int(back or 0)) if end else int(index) if index is not None else plain if plain is not None else _json.loads(f'"{quoted}"'))
        at = m.end()
    return out


class _MISSING:
    """What a path that leads nowhere finds; a class, so that it is one object in every process."""


def _find(v: Any, step: Any) -> Any:
    """The place of a step in v (index into the list of items or pairs), or None."""
    if isinstance(step, str):
        return next((i for i, (k, _) in enumerate(v) if k == step), None) if isinstance(v, Obj) else None
    if isinstance(v, Obj) or not isinstance(v, list):
        return None
    i = len(v) - step[1] if isinstance(step, tuple) else step
    return i if 0 <= i < len(v) else None


def get(v: Any, path: str) -> Any:
    for step in path_steps(path):
        i = _find(v, step)
        if i is None:
            return _MISSING
        v = v[i][1] if isinstance(v, Obj) else v[i]
    return v


def _put(v: Any, steps: list, new: Any, create: bool, replace: bool) -> Any:
    if not steps:
        return new if replace else v
    step, rest = steps[0], steps[1:]
    i = _find(v, step)
    if i is not None:
        old = v[i][1] if isinstance(v, Obj) else v[i]
        changed = _put(old, rest, new, create, replace)
        v[i] = (v[i][0], changed) if isinstance(v, Obj) else changed
        return v
    if create:
        fresh = new if not rest else _put(Obj() if isinstance(rest[0], str) else [], rest, new, True, True)
        if isinstance(step, str) and isinstance(v, Obj):
            v.append((step, fresh))
        elif isinstance(v, list) and not isinstance(v, Obj) and (step == ("#", 0) or step == len(v)):
            v.append(fresh)
    return v


def _delete(v: Any, steps: list) -> Any:
    i = _find(v, steps[0])
    if i is None:
        return v
    if len(steps) == 1:
        del v[i]
    else:
        inner = v[i][1] if isinstance(v, Obj) else v[i]
        _delete(inner, steps[1:])
    return v


def _merge(target: Any, patch: Any) -> Any:
    if not isinstance(patch, Obj):
        return patch
    out = Obj(target) if isinstance(target, Obj) else Obj()
    for k, p in patch:
        i = _find(out, k)
        if p is None:
            if i is not None:
                del out[i]
        elif i is None:
            out.append((k, _merge(None, p)))
        else:
            out[i] = (k, _merge(out[i][1], p))
    return out


def kind_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Number):
        return "integer" if re.fullmatch(r"-?[0-9]+", v) else "real"
    return "text" if isinstance(v, str) else "object" if isinstance(v, Obj) else "array"


def as_value(v: Any) -> str | None:
    """An SQL value as text: 1 and 0 for true and false, a container as JSON, a missing one as NULL."""
    if v is None or v is _MISSING:
        return None
    if isinstance(v, bool):
        return str(int(v))
    return str(v) if isinstance(v, str) else dump(v)


def model(v: Any) -> Any:
    """A Python value as a document."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (bytes, bytearray)):
        raise ValueError("JSON cannot hold BLOB values")
    return Number(repr(int(v)) if isinstance(v, int) or hasattr(v, "dtype") and v.dtype.kind in "iu" else repr(float(v)))


def _rows(kind: str, function, *columns: Column) -> Column:
    """A row function on Python values in an Arrow batch. A NULL first argument gives NULL."""

    @F.pandas_udf(kind)
    def apply(*series: pd.Series) -> pd.Series:
        def one(row: tuple) -> Any:
            values = [None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in row]
            return None if values[0] is None else function(*values)

        return pd.Series([one(r) for r in zip(*series)], dtype="object")

    return apply(*columns)


def json(x: Column) -> Column:
    """Checked and minified; malformed JSON is an error."""
    return _rows("string", lambda t: dump(parse(t)), x)


def json_valid(x: Column, flags: int = 1) -> Column:
    """1 or 0. flags: 1 strict JSON, 2 JSON5 too (4 and 8, for blobs, hold for no text)."""
    if not 1 <= flags <= 15:
        raise ValueError("FLAGS parameter to json_valid() must be between 1 and 15")

    def one(t: str) -> int:
        try:
            if flags & 3:
                parse(t, strict=not flags & 2)
                return 1
        except JsonError:
            pass
        return 0

    if flags & 3:
        sure = F.try_parse_json(x).isNotNull()
        return F.when(sure, 1).otherwise(_rows("int", one, F.when(~sure, x)))
    return _rows("int", one, x)


def json_error_position(x: Column) -> Column:
    def one(t: str) -> int:
        try:
            parse(t)
        except JsonError as e:
            return e.position
        return 0

    return _rows("int", one, x)


def json_pretty(x: Column, indent: str = "    ") -> Column:
    return _rows("string", lambda t: dump(parse(t), indent), x)


def json_quote(x: Column, kind: str = "string") -> Column:
    if kind == "binary":
        raise ValueError("JSON cannot hold BLOB values")
    return F.coalesce(_quoted(x) if kind == "string" else F.when(x, "true").otherwise("false") if kind == "boolean" else x.cast("string"), F.lit("null"))


def _quoted(x: Column) -> Column:
    """A text as a JSON string, by the JVM: the value of a one-field object."""
    return F.when(x.isNotNull(), F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def _simple(path: str) -> bool:
    return bool(re.fullmatch(r"\$(\.[A-Za-z_]\w*|\[[0-9]+\])+", path))


def _variant(x: Column, path: str) -> tuple[Column, Column, Column]:
    """(whether x parses, the part at a simple path, its type's name) by the JVM."""
    whole = F.try_parse_json(x)
    part = whole if path == "$" else F.try_variant_get(whole, path, "variant")
    return whole.isNotNull(), part, F.schema_of_variant(part)


def _plain(path: str) -> str | None:
    """A path without quotes where its labels need none."""
    bare = re.sub(r'\."([A-Za-z_]\w*)"', r".\1", path)
    return bare if bare == "$" or _simple(bare) else None


def _read(x: Column, path: str, simple: dict[str, Any], python) -> Column:
    """A part's value: by simple (type name: function of the part) in the JVM, for other types and texts by python."""
    bare = _plain(path)
    if bare is None:
        return _rows("string", python, x)
    parses, part, kind = _variant(x, bare)
    done = parses & (part.isNull() | kind.isin(*simple))
    out = F.lit(None).cast("string")
    for name, make in simple.items():
        out = F.when(kind == name, make(part)).otherwise(out)
    return F.when(done, out).otherwise(_rows("string", python, F.when(~done | done.isNull(), x)))


def _cell(kind: str):
    return lambda part: F.try_variant_get(part, "$", kind)


_VALUES = {"BIGINT": _cell("string"), "STRING": _cell("string"), "BOOLEAN": lambda p: _cell("boolean")(p).cast("int").cast("string"), "VOID": lambda p: F.lit(None).cast("string")}
_TEXTS = {"BIGINT": _cell("string"), "STRING": lambda p: _quoted(_cell("string")(p)), "BOOLEAN": _cell("string"), "VOID": lambda p: F.lit("null")}
_TYPES = {"BIGINT": lambda p: F.lit("integer"), "STRING": lambda p: F.lit("text"), "BOOLEAN": _cell("string"), "VOID": lambda p: F.lit("null"), "DOUBLE": lambda p: F.lit("real")}


def json_extract(x: Column, *paths: str, as_type: str | None = None) -> Column:
    """One path: the SQL value as text (or cast to as_type); several: a JSON array.

    Without as_type true and false come as 1 and 0. With as_type a plain path is a built-in expression; use it wherever
    the field's type is known.
    """
    if len(paths) == 1 and as_type and _simple(paths[0]):
        return F.get_json_object(x, paths[0]).try_cast(as_type)
    if len(paths) == 1:
        out = _read(x, paths[0], _VALUES, lambda t: as_value(get(parse(t), paths[0])))
        return out.try_cast(as_type) if as_type else out

    def many(t: str) -> str:
        v = parse(t)
        return dump([None if (r := get(v, p)) is _MISSING else r for p in paths])

    return _rows("string", many, x)


def arrow(x: Column, key: str | int) -> Column:
    """x -> key: the JSON text of the part, NULL if missing. key: a path, a label, or an index (negative: from the end)."""
    path = _arrow_path(key)
    return _read(x, path, _TEXTS, lambda t: None if (r := get(parse(t), path)) is _MISSING else dump(r))


def arrow_value(x: Column, key: str | int) -> Column:
    """x ->> key: the SQL value as text."""
    path = _arrow_path(key)
    return _read(x, path, _VALUES, lambda t: as_value(get(parse(t), path)))


def _arrow_path(key: str | int) -> str:
    if isinstance(key, int):
        return f"$[{key}]" if key >= 0 else f"$[#{key}]"
    return key if key.startswith("$") else f"$.{_json.dumps(key)}"


def json_type(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; NULL if the path is missing."""
    python = lambda t: None if (r := get(parse(t), path)) is _MISSING else kind_of(r)
    if _plain(path) is None:
        return _rows("string", python, x)
    parses, part, kind = _variant(x, _plain(path) or "$")
    simple = _read(F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")) | ~parses | part.isNull() | kind.isNull(), x), path, _TYPES, python)
    return F.when(parses & kind.startswith("OBJECT"), "object").when(parses & kind.startswith("ARRAY"), "array").otherwise(simple)


def _element(x: Column | Any, kind: str) -> Column:
    """A value as JSON text. kind: string, json (already JSON), boolean or other."""
    x = lit(x)
    return F.coalesce(x if kind == "json" else json_quote(x, kind), F.lit("null"))


def json_array(*xs: tuple[Column, str]) -> Column:
    """Of (value, kind) pairs."""
    if not xs:
        return F.lit("[]")
    return F.concat(F.lit("["), F.concat_ws(",", *(_element(x, k) for x, k in xs)), F.lit("]"))


def json_object(*pairs: tuple[str, Column, str]) -> Column:
    """Of (label, value, kind) triples; duplicate labels stay."""
    if not pairs:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(_json.dumps(n, ensure_ascii=False) + ":"), _element(x, k)) for n, x, k in pairs)), F.lit("}"))


def json_array_length(x: Column, path: str = "$") -> Column:
    """0 for what is no array, NULL for a missing path."""
    if path == "$":
        return F.when(x.isNotNull(), F.coalesce(F.json_array_length(x), F.lit(0)))

    def one(t: str) -> int | None:
        r = get(parse(t), path)
        return None if r is _MISSING else len(r) if kind_of(r) == "array" else 0

    return _rows("int", one, x)


def json_remove(x: Column, *paths: str) -> Column:
    def one(t: str) -> str | None:
        v = parse(t)
        for p in paths:
            steps = path_steps(p)
            if not steps:
                return None
            v = _delete(v, steps)
        return dump(v)

    return _rows("string", one, x)


def _write(x: Column, changes: tuple[tuple[str, Any], ...], create: bool, replace: bool) -> Column:
    paths = [p for p, _ in changes]

    def one(t: str, *values: Any) -> str:
        v = parse(t)
        for p, new in zip(paths, values):
            v = _put(v, path_steps(p), model(new), create, replace)
        return dump(v)

    return _rows("string", one, x, *(lit(c) for _, c in changes))


def json_set(x: Column, *changes: tuple[str, Any]) -> Column:
    """Of (path, value) pairs: create or overwrite."""
    return _write(x, changes, True, True)


def json_insert(x: Column, *changes: tuple[str, Any]) -> Column:
    return _write(x, changes, True, False)


def json_replace(x: Column, *changes: tuple[str, Any]) -> Column:
    return _write(x, changes, False, True)


def json_patch(x: Column, patch: Column) -> Column:
    """RFC 7396 merge; NULL if either is NULL."""
    return _rows("string", lambda t, p: None if p is None else dump(_merge(parse(t), parse(p))), x, lit(patch))


def jsonb(x: Column) -> Column:
    """A VARIANT; the jsonb_ functions are the json_ ones with a VARIANT result."""
    return F.parse_json(json(x))


def jsonb_extract(x: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(F.parse_json(x), path, as_type)


def jsonb_array(*xs: tuple[Column, str]) -> Column:
    return F.parse_json(json_array(*xs))


def jsonb_object(*pairs: tuple[str, Column, str]) -> Column:
    return F.parse_json(json_object(*pairs))


def jsonb_remove(x: Column, *paths: str) -> Column:
    return F.parse_json(json_remove(x, *paths))


def jsonb_set(x: Column, *changes: tuple[str, Any]) -> Column:
    return F.parse_json(json_set(x, *changes))


def jsonb_insert(x: Column, *changes: tuple[str, Any]) -> Column:
    return F.parse_json(json_insert(x, *changes))


def jsonb_replace(x: Column, *changes: tuple[str, Any]) -> Column:
    return F.parse_json(json_replace(x, *changes))


def jsonb_patch(x: Column, patch: Column) -> Column:
    return F.parse_json(json_patch(x, patch))
