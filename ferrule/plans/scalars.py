"""Scalar function queries: a column for each function."""

from __future__ import annotations


from pyspark.sql import functions as F

from ferrule.functions import dates, jsons, maths, nulls, strings
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("fn_string_basic", "SELECT p_partkey, length(p_name)::INTEGER AS len, strlen(p_name)::INTEGER AS bytes, lower(p_type) AS lo, upper(p_name) AS up, trim(p_name, 'aeg') AS tr, ltrim(p_name, 'aeg') AS lt, rtrim(p_name, 'aeg') AS rt, instr(p_name, 'e')::INTEGER AS i, replace(p_name, 'a', '<a>') AS rep, p_name AS same FROM part")
def _(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", strings.length(n).alias("len"), strings.octet_length(n).alias("bytes"), strings.lower(F.col("p_type")).alias("lo"), strings.upper(n).alias("up"), strings.trim(n, "aeg").alias("tr"), strings.ltrim(n, "aeg").alias("lt"), strings.rtrim(n, "aeg").alias("rt"), strings.instr(n, "e").alias("i"), strings.replace(n, "a", "<a>").alias("rep"), strings.replace(n, "", "x").alias("same"))


@R.add("fn_string_substr", "SELECT c_custkey, substr(c_name, 3) AS a, substr(c_name, 2, 4) AS b, substr(c_name, -3) AS c, substr(c_name, -3, 2) AS d, substr(c_name, 1, 1) AS e, substr(c_name, 2, 3) AS f FROM customer")
def _(t):
    n, s = F.col("c_name"), strings.substr
    return t("customer").select("c_custkey", s(n, 3).alias("a"), s(n, 2, 4).alias("b"), s(n, -3).alias("c"), s(n, -3, 2).alias("d"), s(n, 0, 2).alias("e"), s(n, 5, -3).alias("f"))


@R.add("fn_string_concat", "SELECT o_orderkey, concat(o_orderstatus, '-', o_orderpriority) AS c, concat_ws('|', o_orderstatus, o_orderpriority) AS w, o_orderstatus AS skip, NULL::VARCHAR AS none FROM orders")
def _(t):
    s, p, nothing = F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None).cast("string")
    return t("orders").select("o_orderkey", strings.concat(s, "-", p).alias("c"), strings.concat_ws("|", s, nothing, p).alias("w"), strings.concat(s, nothing).alias("skip"), strings.concat_ws(nothing, s, p).alias("none"))


@R.add("fn_string_codes", "SELECT p_partkey, hex(p_name) AS h, hex(p_size::VARCHAR) AS hn, unicode(p_name)::BIGINT AS u, chr(65 + p_size % 26) || chr(8364) AS c, decode(unhex(hex(p_name))) AS back, NULL::VARCHAR AS odd, '''' || replace(p_name, '''', '''''') || '''' AS q, p_size::VARCHAR AS qn, 3 AS z FROM part")
def _(t):
    n, s = F.col("p_name"), F.col("p_size")
    return t("part").select("p_partkey", strings.hex_(n).alias("h"), strings.hex_(s).alias("hn"), strings.unicode(n).alias("u"), strings.char(65 + s % 26, F.lit(8364)).alias("c"), strings.unhex(strings.hex_(n)).cast("string").alias("back"), strings.unhex(F.lit("abc")).cast("string").alias("odd"), strings.quote(n).alias("q"), strings.quote(s, "other").alias("qn"), F.octet_length(strings.zeroblob(3)).alias("z"))


@R.add("fn_printf", "SELECT o_orderkey, printf('%05d|%-8s|%.2f', o_orderkey, o_orderstatus, o_totalprice) AS a, 'k=' || o_orderkey || ' s=' || o_orderstatus AS b, '''' || o_orderstatus || '''' AS q, format('{:,}', o_orderkey) AS c FROM orders")
def _(t):
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    return t("orders").select("o_orderkey", strings.printf("%05d|%-8s|%.2f", k, s, p).alias("a"), strings.printf("k=%d s=%s", k, s).alias("b"), strings.printf("%Q", s).alias("q"), strings.printf("%,d", k).alias("c"))


@R.add("fn_null_conditional", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1.0) AS co, ifnull(NULL::VARCHAR, c_name) AS ifn, nullif(c_nationkey, 5) AS nu, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS i, NULL::INTEGER AS mn, least(c_nationkey, 7) AS mn2, greatest(c_nationkey, 7, 9) AS mx FROM customer")
def _(t):
    a, k, n = F.col("c_acctbal"), F.col("c_nationkey"), F.lit(None).cast("int")
    return t("customer").select("c_custkey", nulls.coalesce(F.when(a > 0, a), F.lit(-1.0)).alias("co"), nulls.ifnull(F.lit(None).cast("string"), F.col("c_name")).alias("ifn"), nulls.nullif(k, 5).alias("nu"), nulls.iif(a < 0, "neg", a < 1000, "low", "ok").alias("i"), nulls.min_(k, n).alias("mn"), nulls.min_(k, 7).alias("mn2"), nulls.max_(k, 7, 9).alias("mx"))


@R.add("fn_type", "SELECT c_custkey, 'integer' AS a, CASE WHEN c_acctbal > 0 THEN 'real' ELSE 'null' END AS b, 'text' AS c, 0 AS s, c_name AS l FROM customer")
def _(t):
    a = F.col("c_acctbal")
    return t("customer").select("c_custkey", nulls.typeof(F.col("c_custkey"), "bigint").alias("a"), nulls.typeof(F.when(a > 0, a), "double").alias("b"), nulls.typeof(F.col("c_name"), "string").alias("c"), nulls.subtype(a).alias("s"), nulls.likely(nulls.unlikely(nulls.likelihood(F.col("c_name"), 0.5))).alias("l"))


@R.add("fn_session", f"SELECT '{nulls.VERSION}' AS v, '{nulls.SOURCE_ID}' AS s, 1 AS used, 0 AS unused, '{nulls.COMPILE_OPTIONS[0]}' AS o, NULL::VARCHAR AS log")
def _(t):
    one = t("region").sparkSession.range(1)
    return one.select(nulls.sqlite_version().alias("v"), nulls.sqlite_source_id().alias("s"), nulls.sqlite_compileoption_used("ENABLE_JSON1").alias("used"), nulls.sqlite_compileoption_used("NOPE").alias("unused"), nulls.sqlite_compileoption_get(0).alias("o"), nulls.sqlite_log(F.lit(1), F.lit("m")).alias("log"))


_ANGLES = ["sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "asinh", "degrees", "radians", "exp"]
_POSITIVE = ["ln", "log10", "log2", "sqrt", "acosh"]
_UNIT = ["asin", "acos"]


@R.add(
    "fn_math",
    "SELECT id, "
    + ", ".join(f"round({f}(x), 9) AS {f}" for f in _ANGLES)
    + ", "
    + ", ".join(f"CASE WHEN y {'>= 1' if f == 'acosh' else '>= 0' if f == 'sqrt' else '> 0'} THEN round({f}(y), 9) END AS {f}" for f in _POSITIVE)
    + ", "
    + ", ".join(f"CASE WHEN u BETWEEN -1 AND 1 THEN round({f}(u), 9) END AS {f}" for f in _UNIT)
    + ", CASE WHEN u > -1 AND u < 1 THEN round(atanh(u), 9) END AS atanh, round(atan2(x, y), 9) AS atan2, round(pow(x, 2), 9) AS power, CASE WHEN y > 0 THEN round(log10(y), 9) END AS log, CASE WHEN y > 0 THEN round(ln(y) / ln(2), 9) END AS logb"
    + ", NULL::DOUBLE AS log1, round(pi(), 9) AS pi FROM (SELECT p_partkey AS id, p_size / 10.0 AS x, (p_size - 5)::DOUBLE AS y, (p_size - 25) / 20.0 AS u FROM part)",
)
def _(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("x"), (F.col("p_size") - 5).cast("double").alias("y"), ((F.col("p_size") - 25) / 20.0).alias("u"))
    x, y, u = F.col("x"), F.col("y"), F.col("u")
    cols = [getattr(maths, f)(x).alias(f) for f in _ANGLES] + [getattr(maths, f)(y).alias(f) for f in _POSITIVE] + [getattr(maths, f)(u).alias(f) for f in (*_UNIT, "atanh")]
    cols += [maths.atan2(x, y).alias("atan2"), maths.power(x, F.lit(2)).alias("power"), maths.log(y).alias("log"), maths.log(F.lit(2), y).alias("logb"), maths.log(F.lit(1), y).alias("log1"), maths.pi().alias("pi")]
    out = rows.select("id", *cols)
    return out.select("id", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@R.add("fn_math_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS r0, sign(l_discount - 0.05)::INTEGER AS sg, abs(l_discount - 0.05) AS ab, ceil(l_extendedprice) AS ce, floor(-l_extendedprice) AS fl, trunc(-l_extendedprice) AS tr, fmod(l_extendedprice, 7) AS mo, NULL::DOUBLE AS mz, 2.67 AS tie FROM lineitem")
def _(t):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", maths.round_(p).alias("r0"), maths.sign(d - 0.05).alias("sg"), maths.abs_(d - 0.05).alias("ab"), maths.ceil(p).alias("ce"), maths.floor(-p).alias("fl"), maths.trunc(-p).alias("tr"), maths.mod(p, F.lit(7)).alias("mo"), maths.mod(p, F.lit(0)).alias("mz"), maths.round_(F.lit(2.675), 2).alias("tie"))


@R.add(
    "fn_date",
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS da, strftime(d, '%H:%M:%S') AS ti, strftime(d, '%Y-%m-%d %H:%M:%S') AS dt, epoch(d) / 86400.0 + 2440587.5 AS jd, epoch(d)::BIGINT AS ue,
    strftime(date_trunc('month', d), '%Y-%m-%d') AS sm, strftime(date_trunc('year', d), '%Y-%m-%d') AS sy, strftime(d + INTERVAL 10 DAY, '%Y-%m-%d') AS p10, strftime(d - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS m90,
    strftime(date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS eom, strftime(date_trunc('day', d) + to_days(((7 - dayofweek(d)) % 7)::INTEGER), '%Y-%m-%d') AS sunday,
    strftime(date_trunc('month', d) + INTERVAL 1 MONTH + to_days((day(d) - 1)::INTEGER), '%Y-%m-%d') AS roll FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def _(t):
    d, k = F.col("o_orderdate"), {"kind": "timestamp"}
    return t("orders").select(
        "o_orderkey", dates.date(d, **k).alias("da"), dates.time(d, **k).alias("ti"), dates.datetime(d, **k).alias("dt"), dates.julianday(d, **k).alias("jd"), dates.unixepoch(d, **k).alias("ue"),
        dates.date(d, "start of month", **k).alias("sm"), dates.date(d, "start of year", **k).alias("sy"), dates.date(d, "+10 day", **k).alias("p10"), dates.datetime(d, "-90 minute", **k).alias("m90"),
        dates.date(d, "start of month", "+1 month", "-1 day", **k).alias("eom"), dates.date(d, "weekday 0", **k).alias("sunday"), dates.date(d, "+1 month", **k).alias("roll"),
    )


@R.add(
    "fn_strftime",
    """SELECT o_orderkey, strftime(d, '%j %w %u %U %W %V %G %H %I %M %S %p %%') AS s, strftime(d, '%d/%m/%Y') AS dmy, epoch(d)::BIGINT::VARCHAR AS ep, NULL::VARCHAR AS bad FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""",
)
def _(t):
    d, k = F.col("o_orderdate"), {"kind": "timestamp"}
    return t("orders").select("o_orderkey", dates.strftime("%j %w %u %U %W %V %G %H %I %M %S %p %%", d, **k).alias("s"), dates.strftime("%d/%m/%Y", d, **k).alias("dmy"), dates.strftime("%s", d, **k).alias("ep"), dates.strftime("%Q", d, **k).alias("bad"))


@R.add(
    "fn_date_text",
    """SELECT * FROM (VALUES ('2024-02-29', '2024-02-29 00:00:00', '2025-03-01'), ('2024-01-31', '2024-01-31 00:00:00', '2025-01-31'), ('2024-02-29 13:05:09.123', '2024-02-29 13:05:09', '2025-03-01'),
    ('13:05:09', '2000-01-01 13:05:09', '2001-01-01'), ('2024-02-29T13:05:09+02:00', '2024-02-29 11:05:09', '2025-03-01'), ('bad', NULL, NULL), (NULL, NULL, NULL)) v(t, dt, next_year)""",
)
def _(t):
    rows = [("2024-02-29",), ("2024-01-31",), ("2024-02-29 13:05:09.123",), ("13:05:09",), ("2024-02-29T13:05:09+02:00",), ("bad",), (None,)]
    x = F.col("t")
    return t("region").sparkSession.createDataFrame(rows, "t string").select("t", dates.datetime(x).alias("dt"), dates.date(x, "+1 year").alias("next_year"))


@R.add("fn_timediff", "SELECT * FROM (VALUES (1, '+0000-00-01 00:00:00.000'), (2, '-0001-00-00 12:00:00.500'), (3, '+0000-01-01 00:00:00.000')) v(id, d)")
def _(t):
    rows = [(1, "2024-03-01", "2024-02-29"), (2, "2023-01-01", "2024-01-01 12:00:00.500"), (3, "2024-03-02", "2024-02-01")]
    return t("region").sparkSession.createDataFrame(rows, "id int, a string, b string").select("id", dates.timediff(F.col("a"), F.col("b")).alias("d"))


@R.add("fn_json_read", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.k' AS v, (props->'$.k')::VARCHAR AS j, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE lower(json_type(props, '$.k')) END AS ty, 'object' AS top, json_valid(props)::INTEGER AS ok, 0 AS n FROM events")
def _(t):
    p = F.col("props")
    return t("events").select("event_id", jsons.json_extract(p, "$.k", as_type="bigint").alias("k"), jsons.arrow_value(p, "k").alias("v"), jsons.arrow(p, "k").alias("j"), jsons.json_type(p, "$.k").alias("ty"), jsons.json_type(p).alias("top"), jsons.json_valid(p).alias("ok"), jsons.json_array_length(p).alias("n"))


@R.add("fn_json_build", "SELECT c_custkey, '[' || c_custkey || ',\"' || c_name || '\",null]' AS a, '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS o, '\"' || c_name || '\"' AS q FROM customer")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_name")
    return t("customer").select("c_custkey", jsons.json_array((k, "other"), (n, "string"), (F.lit(None).cast("string"), "string")).alias("a"), jsons.json_object(("id", k, "other"), ("name", n, "string")).alias("o"), jsons.json_quote(n).alias("q"))


@R.add(
    "fn_json_change",
    """SELECT event_id, '{"k":' || k || ',"e":' || event_id || '}' AS s, '{"k":' || k || ',"n":1}' AS i, '{"k":null}' AS r, '{}' AS d, '{"k":' || k || ',"x":{"y":2}}' AS p, '{"k":' || k || '}' AS m FROM (SELECT event_id, (props->>'$.k') AS k FROM events)""",
)
def _(t):
    p = F.col("props")
    return t("events").select(
        "event_id", jsons.json_set(p, ("$.e", F.col("event_id"))).alias("s"), jsons.json_insert(p, ("$.k", 0), ("$.n", 1)).alias("i"), jsons.json_replace(p, ("$.k", None), ("$.z", 1)).alias("r"),
        jsons.json_remove(p, "$.k").alias("d"), jsons.json_patch(p, F.lit('{"x":{"y":2,"z":null}}')).alias("p"), jsons.json(p).alias("m"),
    )


@R.add("fn_jsonb", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    return t("events").select("event_id", jsons.jsonb_extract(F.col("props"), "$.k", "bigint").alias("k"))


