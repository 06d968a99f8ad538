"""Truth tables of scalar functions and operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ferrule.functions import dates, jsons, maths, nulls, strings
from ferrule.functions import operators as op


@pytest.fixture
def one(spark):
    def value(*columns):
        return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()

    return lambda *c: tuple(value(*c))


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("args, want", [(("hello", 0, 2), "h"), (("hello", 2), "ello"), (("hello", -3), "llo"), (("hello", -3, 2), "ll"), (("hello", 5, -3), "ell"), (("hello", 0), "hello"), (("hello", 9), ""), (("hello", -9, 6), "he"), (("hello", 2, 0), ""), (("hello", -2, -2), "el")])
def test_substr(one, args, want):
    assert one(strings.substr(s(args[0]), *args[1:])) == (want,)


def test_strings(one):
    assert one(strings.lower(s("ÉA")), strings.upper(s("éa")), strings.trim(s("  x ")), strings.ltrim(s("xxay"), "xa"), strings.rtrim(s("yaxx"), "xa")) == ("Éa", "éA", "x", "y", "y")
    assert one(strings.instr(s("abc"), ""), strings.instr(s("abc"), "z"), strings.replace(s("aaa"), "", "x"), strings.length(s("é€")), strings.octet_length(s("é€"))) == (1, 0, "aaa", 2, 5)
    assert one(strings.hex_(s("é")), strings.hex_(F.lit(12)), strings.hex_(s(None)), strings.unhex(s("41 42"), " ").cast("string"), strings.unhex(s("4")), strings.unhex(s("4g"))) == ("C3A9", "3132", "", "AB", None, None)
    assert one(strings.unicode(s("€")), strings.unicode(s("")), strings.char(8364, None, 0xD800), strings.quote(s("it's")), strings.quote(s(None)), strings.quote(F.lit(1.5), "double")) == (8364, None, "€�", "'it''s'", "NULL", "1.5")
    assert one(strings.concat(s("a"), s(None), 1), strings.concat_ws("-", s("a"), s(None), s("b")), op.concat(s("a"), s(None))) == ("a1", "a-b", None)
    assert one(strings.unistr(s(r"\0041é\\\+01F600")), strings.unistr_quote(s("a\nb")), strings.unistr_quote(s("a'b"))) == ("Aé\\😀", "unistr('a\\u000ab')", "'a''b'")


@pytest.mark.parametrize(
    "template, args, want",
    [("%5d|%-5d|%05d", [42, 42, -42], "   42|42   |-0042"), ("%+d % d %,d", [1, 2, 1234567], "+1  2 1,234,567"), ("%.2f %e %g", [2.5, 12345.678, 0.0001], "2.50 1.234568e+04 0.0001"), ("%x %X %o %#x", [255, 255, 8, 255], "ff FF 10 0xff"), ("%c%5s|%-5s|%.2s", ["xy", "a", "b", "cde"], "x    a|b    |cd"), ("%q %Q %Q %w", ["it's", "it's", None, 'a"b'], "it''s 'it''s' NULL a\"\"b"), ("%r %r %r", [1, 12, 23], "1st 12th 23rd"), ("%%|%*d|%d", [4, 7], "%|   7|0")],
)
def test_printf(template, args, want):
    assert strings.format_text(template, args) == want


def test_printf_column(one):
    assert one(strings.printf("%05d-%s", F.lit(7), s("x")), strings.printf("%d %s", F.lit(7), s(None)), strings.printf("%Q", s("a'b"))) == ("00007-x", "7 ", "'a''b'")


@pytest.mark.parametrize("x, n, want", [(2.675, 2, 2.67), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.285, 2, 0.28), (1.005, 2, 1.0), (1234.5, 0, 1235.0), (1e300, 3, 1e300), (0.1, 20, 0.1), (-0.4, 0, 0.0)])
def test_round(one, x, n, want):
    assert one(maths.round_(F.lit(x), n))[0] == want


def test_math_domains(one):
    x = F.lit
    assert one(maths.sqrt(x(-1.0)), maths.ln(x(0.0)), maths.log10(x(-1.0)), maths.log(x(1.0), x(5.0)), maths.asin(x(2.0)), maths.acosh(x(0.5)), maths.atanh(x(1.0)), maths.mod(x(1.0), x(0.0))) == (None,) * 8
    assert one(maths.log(x(100.0)), maths.trunc(x(-2.7)), maths.ceil(x(2), "int"), maths.sign(s("x")), maths.sign(x(-3.0)), F.octet_length(maths.randomblob(11))) == (2.0, -2.0, 2, None, -1, 11)
    assert math.isclose(one(maths.log(x(2.0), x(8.0)))[0], 3.0)


def test_operators(one):
    i = lambda v: F.lit(v).cast("long")
    assert one(op.int_div(i(-7), i(2)), op.int_div(i(7), i(0)), op.mod(F.lit(-7.9), F.lit(2)), op.add(i(op.MAX_LONG), i(1)), op.real_div(i(1), F.lit(0.0))) == (-3, None, -1, float(2**63), None)
    assert one(op.shift_left(i(1), 64), op.shift_left(i(1), 63), op.shift_right(i(-8), 70), op.shift_right(i(8), -1), op.shift_left(i(8), -2)) == (0, op.MIN_LONG, -1, 16, 2)
    assert one(op.real_text(F.lit(1e20)), op.real_text(F.lit(-1e-7)), op.real_text(F.lit(3.0)), op.real_text(F.lit(0.1))) == ("100000000000000000000.0", "-0.0000001", "3.0", "0.1")
    assert one(op.cast_integer(F.lit(1e300), "double"), op.cast_integer(F.lit(-2.9), "double"), op.cast_integer(s("-99999999999999999999")), op.cast_real(s(".5e1x"))) == (op.MAX_LONG, -2, op.MIN_LONG, 5.0)


@pytest.mark.parametrize("pattern, escape, text, want", [("a%", None, "ABC", True), ("É", None, "é", False), ("a!%b", "!", "a%b", True), ("a!%b", "!", "axb", False), ("_", None, "\n", True), ("a\\b", None, "a\\b", True), ("x", None, None, None), ("a!", "!", "a", False)])
def test_like(one, pattern, escape, text, want):
    assert one(op.like(s(text), pattern, escape)) == (want,)


@pytest.mark.parametrize("pattern, text, want", [("a*", "abc", True), ("A*", "abc", False), ("[a-c]?", "bz", True), ("[^a-c]?", "bz", False), ("[]x]", "]", True), ("*.[ch]", "x.c", True), ("a", "ab", False), ("[", "[", False), ("?", "\n", True), ("a+b*", "a+bc", True)])
def test_glob(one, pattern, text, want):
    assert one(op.glob(s(text), pattern)) == (want,)


@pytest.mark.parametrize("pattern, text, want", [("^a.c$", "abc", True), ("b", "abc", True), ("a+", "aa", False), ("a+", "a+", True), ("[0-9]x", "5x", True), ("(", "(", True)])
def test_regexp(one, pattern, text, want):
    assert one(op.regexp(s(text), pattern)) == (want,)


def test_bad_patterns():
    with pytest.raises(ValueError):
        op.regexp(F.lit("x"), "[a")
    with pytest.raises(ValueError):
        op.match("x", "y")
    with pytest.raises(ValueError):
        op.like(F.lit("x"), "a", "!!")


def test_nulls(one):
    n = s(None)
    assert one(nulls.min_(F.lit(1), n.cast("int")), nulls.max_(F.lit(1), F.lit(2)), nulls.iif(F.lit(False), s("a"), F.lit(None).cast("boolean"), s("b")), nulls.iif(F.lit(True), s("a"), s("b")), nulls.typeof(n, "string"), nulls.typeof(F.lit(b"x"), "binary")) == (None, 2, None, "a", "null", "blob")
    with pytest.raises(ValueError):
        nulls.likelihood(F.lit(1), 2.0)


@pytest.mark.parametrize(
    "args, want",
    [
        (("2024-02-29 13:05:09",), "2024-02-29 13:05:09"), (("2024-02-29T13:05:09+02:00",), "2024-02-29 11:05:09"), (("13:05:09",), "2000-01-01 13:05:09"), (("2024-13-01",), None), (("bad",), None), (("12",), None),
        (("2024-01-31", "+1 month"), "2024-03-02 00:00:00"), (("2024-01-31", "+1 month", "floor"), "2024-02-29 00:00:00"), (("2024-02-29", "+1 year"), "2025-03-01 00:00:00"), (("2024-02-29", "-1 year", "floor"), "2023-02-28 00:00:00"),
        (("2024-05-05 10:20:30", "start of month", "-1 day"), "2024-04-30 00:00:00"), (("2024-05-05", "weekday 0"), "2024-05-05 00:00:00"), (("2024-05-05", "weekday 1"), "2024-05-06 00:00:00"), (("2024-05-05", "1.5 hour"), "2024-05-05 01:30:00"), (("2024-05-05", "localtime"), None),
    ],
)
def test_datetime(one, args, want):
    assert one(dates.datetime(*args)) == (want,)


def test_other_dates(one):
    assert one(dates.julianday("2000-01-01"), dates.unixepoch("1970-01-02"), dates.time("13:05:09.123", "subsec"), dates.datetime(F.lit(86400), "unixepoch", kind="number"), dates.datetime(F.lit(2451544.5), "auto", kind="number"), dates.datetime(F.lit(5), kind="number")) == (2451544.5, 86400, "13:05:09.123", "1970-01-02 00:00:00", "2000-01-01 00:00:00", None)
    assert one(dates.strftime("%e|%k|%l|%P|%f|%J|%R|%T|%F|%g", "2024-01-01 13:05:09.123")) == (" 1|13| 1|pm|09.123|2460311.045244479|13:05|13:05:09|2024-01-01|24",)
    d = dt.datetime
    assert dates.difference(d(2024, 3, 1), d(2024, 2, 29)) == "+0000-00-01 00:00:00.000" and dates.difference(d(2023, 1, 1), d(2024, 1, 1, 12)) == "-0001-00-00 12:00:00.000"


def test_json_model():
    parse, dump = jsons.parse, jsons.dump
    assert dump(parse('{"a":[1,2,{"b":null}], "a": 1.50}')) == '{"a":[1,2,{"b":null}],"a":1.50}'
    assert dump(parse("{a:1, 'b':.5, c:[+1, 0x1F, Infinity,], /* x */ d:NaN, // y\n}")) == '{"a":1,"b":0.5,"c":[1,31,9.0e+999],"d":null}'
    for bad, at in (("{bad", 5), ('{"a":}', 6), ("[1,2", 5), ('"\\q"', 2), ("", 1), ("1 2", 3)):
        with pytest.raises(jsons.JsonError) as e:
            parse(bad)
        assert e.value.position == at, bad
    for strict in ("{a:1}", "[1,]", "'x'", "+1", ".5"):
        parse(strict)
        with pytest.raises(jsons.JsonError):
            parse(strict, strict=True)


def test_json_functions(one):
    j = s('{"a":[1,2.5,{"b":null}],"t":true,"s":"x"}')
    assert one(jsons.json_extract(j, "$.a[#-2]"), jsons.json_extract(j, "$.t"), jsons.json_extract(j, "$.a[2]"), jsons.json_extract(j, "$.z"), jsons.json_extract(j, "$.s", "$.z"), jsons.arrow(j, "s"), jsons.arrow_value(j, "s"), jsons.arrow(s("[1,2]"), -1)) == ("2.5", "1", '{"b":null}', None, '["x",null]', '"x"', "x", "2")
    assert one(*(jsons.json_type(j, p) for p in ("$", "$.a", "$.a[0]", "$.a[1]", "$.a[2].b", "$.t", "$.s", "$.z"))) == ("object", "array", "integer", "real", "null", "true", "text", None)
    assert one(jsons.json_set(j, ("$.a[#]", 9), ("$.n.m", "v")), jsons.json_insert(j, ("$.s", 1)), jsons.json_replace(j, ("$.s", None)), jsons.json_remove(j, "$.a[0]", "$.s"), jsons.json_remove(j, "$")) == ('{"a":[1,2.5,{"b":null},9],"t":true,"s":"x","n":{"m":"v"}}', '{"a":[1,2.5,{"b":null}],"t":true,"s":"x"}', '{"a":[1,2.5,{"b":null}],"t":true,"s":null}', '{"a":[2.5,{"b":null}],"t":true}', None)
    assert one(jsons.json_patch(s('{"a":1,"b":{"c":2}}'), s('{"a":null,"b":{"d":3},"e":[1]}')), jsons.json_valid(s("{a:1}")), jsons.json_valid(s("{a:1}"), 2), jsons.json_error_position(s("{bad")), jsons.json_array_length(s("[1,2]")), jsons.json_array_length(s("{}")), jsons.json_array_length(j, "$.a"), jsons.json_quote(s('a"b'))) == ('{"b":{"c":2,"d":3},"e":[1]}', 0, 1, 5, 2, 0, 3, '"a\\"b"')
    assert one(jsons.json_pretty(s('{"a":[1,{}]}'), "  "), jsons.json_array((F.lit(1), "other"), (s(None), "string"), (F.lit(True), "boolean"))) == ('{\n  "a": [\n    1,\n    {}\n  ]\n}', "[1,null,true]")
    assert one(jsons.jsonb_extract(jsons.jsonb_set(j, ("$.s", 5)).cast("string"), "$.s", "int")) == (5,)


JSON_TEXTS = ['{"a":1}', '{"a":"x\\"y"}', '{"a":true,"b":[1,2]}', '{"a":null}', '{"a":1.50}', '{"a":1e2}', '{"a":12345678901234567890}', '{"b":{"z":1,"a":2},"a":{"z":1,"a":[]}}', '{"a":1,"a":2}', "{a:1}", "[1,2]", '"t"', "7", "null", None, '{"a":-0.0}', '{"a":"é\\u0041"}']


def test_json_reads_of_the_jvm_are_those_of_the_document_model(spark):
    from ferrule.functions import jsons

    df = spark.createDataFrame([(k, t) for k, t in enumerate(JSON_TEXTS)], "id int, j string")
    j = F.col("j")
    cells = [jsons.json_type(j).alias("whole"), jsons.json_type(j, "$.a").alias("type"), jsons.arrow(j, "a").alias("arrow"), jsons.arrow_value(j, "a").alias("value"), jsons.json_extract(j, "$.b[1]").alias("item"), jsons.arrow_value(j, -1).alias("last")]
    got = {r.id: tuple(r)[1:] for r in df.select("id", *cells).collect()}

    def part(t, path, turn):
        found = jsons.get(jsons.parse(t), path)
        return None if found is jsons._MISSING else turn(found)

    for k, t in enumerate(JSON_TEXTS):
        want = (None,) * 6 if t is None else (part(t, "$", jsons.kind_of), part(t, "$.a", jsons.kind_of), part(t, "$.a", jsons.dump), part(t, "$.a", jsons.as_value), part(t, "$.b[1]", jsons.as_value), part(t, "$[#-1]", jsons.as_value))
        assert got[k] == want, t


def test_strict_json_by_the_scanner_is_the_parsers_own():
    from ferrule.functions import jsons

    for t in JSON_TEXTS:
        if t is not None:
            assert jsons.dump(jsons.parse(t)) == jsons.dump(jsons._parse(t, False))
    for t in ("[NaN]", "[Infinity]", "[1,]", "{'a':1}", "[01]", "[1", ""):
        try:
            want = jsons.dump(jsons._parse(t, False))
        except jsons.JsonError as e:
            with pytest.raises(jsons.JsonError) as found:
                jsons.parse(t)
            assert found.value.position == e.position
        else:
            assert jsons.dump(jsons.parse(t)) == want
