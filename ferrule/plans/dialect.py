"""Queries in the dialect's own SQL, through Database.query and Database.execute, next to their DuckDB oracles."""

from __future__ import annotations

import re

from ferrule.database import Database
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def database(t, sql: str) -> Database:
    """A database with those of the driver's tables as views that a text names."""
    db = Database(t("region").sparkSession)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            db.create_view(name, t(name))
    return db


def add(name: str, sql: str, oracle: str | None = None, sums: str = "") -> None:
    """A query; oracle: DuckDB's text where it differs. sums: columns with sums of integers, which DuckDB widens."""
    text = oracle or sql
    if sums:
        text = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in sums.split())}) FROM ({text})"
    R.add(name, text)(lambda t: database(t, sql).query(sql))


def script(name: str, sql: str, oracle: str) -> None:
    """Statements on tables of their own; the last one's rows."""
    R.add(name, oracle)(lambda t: database(t, sql).query(sql))


# Selection and expressions ---------------------------------------------------------------------------------------

add("sql_where_logic", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT o_custkey < 100")
add("sql_alias_in_where", "SELECT o_orderkey, o_custkey % 7 AS m FROM orders WHERE m = 3")
add("sql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0")
add("sql_like_glob", "SELECT p_partkey, p_name LIKE '%A%' AS l, p_name GLOB '*[0-9]' AS g, p_type NOT LIKE 'x!%%' ESCAPE '!' AS e FROM part", "SELECT p_partkey, lower(p_name) LIKE '%a%' AS l, p_name GLOB '*[0-9]' AS g, p_type NOT LIKE 'x!%%' ESCAPE '!' AS e FROM part")
add("sql_in_between", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3) OR s_acctbal BETWEEN 100 AND 2000 OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
add("sql_null_tests", "SELECT n_nationkey, nullif(n_regionkey, 1) IS NULL AS a, nullif(n_regionkey, 1) IS NOT 2 AS b, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS c, (n_regionkey > 2) IS TRUE AS d, nullif(n_regionkey, 1) ISNULL AS e FROM nation",
    "SELECT n_nationkey, nullif(n_regionkey, 1) IS NULL AS a, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS b, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS c, n_regionkey > 2 AS d, nullif(n_regionkey, 1) IS NULL AS e FROM nation")
add("sql_integer_arithmetic", "SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS n, o_custkey % 0 AS z, o_custkey / 0 AS w, o_custkey & 12 AS b, o_custkey << 3 AS l, -o_custkey >> 1 AS r, ~o_custkey AS t, o_custkey | 5 AS v FROM orders",
    "SELECT o_orderkey, o_custkey // 7 AS q, -(o_custkey // 7) AS n, NULL::BIGINT AS z, NULL::BIGINT AS w, o_custkey & 12 AS b, o_custkey * 8 AS l, floor(-o_custkey / 2)::BIGINT AS r, -o_custkey - 1 AS t, o_custkey | 5 AS v FROM orders")
add("sql_overflow", "SELECT r_regionkey, 9223372036854775807 + 1 AS a, 9223372036854775807 * 2 AS b, -9223372036854775807 - 2 AS c FROM region", "SELECT r_regionkey, 9223372036854775808.0::DOUBLE AS a, 18446744073709551614.0::DOUBLE AS b, -9223372036854775809.0::DOUBLE AS c FROM region")
add("sql_text_of_reals", "SELECT r_regionkey, 'a' || 1.5e15 AS a, 2.5 || '' AS b, 1e20 || '' AS c, 0.00001 || '' AS d, 3.0 || '' AS e FROM region", "SELECT r_regionkey, 'a1500000000000000.0' AS a, '2.5' AS b, '100000000000000000000.0' AS c, '0.00001' AS d, '3.0' AS e FROM region")
add("sql_case", "SELECT n_nationkey, CASE WHEN 'abc' THEN 1 ELSE 2 END AS a, CASE WHEN '0' THEN 1 ELSE 2 END AS b, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS c, iif(n_regionkey > 2, 'hi', 'lo') AS d, if(n_name = '', 1, 2) AS e FROM nation",
    "SELECT n_nationkey, 1 AS a, 2 AS b, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS c, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS d, 2 AS e FROM nation")
add("sql_round", "SELECT o_orderkey, round(o_totalprice) AS a, round(-o_totalprice / 7.3, 1) AS b, round(2.675, 2) AS c, round(2.5) AS d, round(-0.5) AS e FROM orders",
    "SELECT o_orderkey, round(o_totalprice) AS a, round(-o_totalprice / 7.3, 1) AS b, 2.67::DOUBLE AS c, 3.0::DOUBLE AS d, -1.0::DOUBLE AS e FROM orders")
add("sql_min_max_scalar", "SELECT n_nationkey, max(n_regionkey, 2) AS a, min(n_regionkey, 2, 3) AS b, max(1, 'a') AS c, min(1, 'a') AS d, max(n_regionkey, NULL) AS e FROM nation",
    "SELECT n_nationkey, greatest(n_regionkey, 2) AS a, least(n_regionkey, 2, 3) AS b, 'a' AS c, 1 AS d, NULL::BIGINT AS e FROM nation")
add("sql_printf", "SELECT p_partkey, printf('%05d|%-8s|%.2f|%q|%,d|%c', p_partkey, p_brand, p_retailprice, 'it''s', 1234567, 'xyz') AS f FROM part", "SELECT p_partkey, printf('%05d|%-8s|%.2f|it''''s|1,234,567|x', p_partkey, p_brand, p_retailprice) AS f FROM part")
add("sql_casts", "SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST('12abc' AS INTEGER) AS p, CAST('1.5e1x' AS REAL) AS r, CAST(o_custkey AS TEXT) AS t, CAST('99999999999999999999' AS INTEGER) AS s FROM orders",
    "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, 12 AS p, 15.0::DOUBLE AS r, o_custkey::VARCHAR AS t, 9223372036854775807 AS s FROM orders")
add("sql_strings", "SELECT p_partkey, substr(p_name, -3, 2) AS a, substring(p_name, 2) AS b, instr(p_name, 'a') AS c, upper(p_type) AS d, trim('xxaxx', 'x') AS e, replace(p_brand, '#', '-') AS f, hex(p_size) AS g, unicode(p_name) AS h, char(72, 105) AS i, quote(p_brand) AS j, concat_ws('/', p_brand, NULL, p_size) AS k, octet_length('é') AS l, length(p_name) AS m FROM part",
    "SELECT p_partkey, substr(p_name, -3, 2) AS a, substr(p_name, 2) AS b, instr(p_name, 'a') AS c, upper(p_type) AS d, 'a' AS e, replace(p_brand, '#', '-') AS f, hex(p_size::VARCHAR) AS g, unicode(p_name) AS h, 'Hi' AS i, '''' || p_brand || '''' AS j, p_brand || '/' || p_size AS k, 2 AS l, length(p_name) AS m FROM part")
add("sql_dates", "SELECT o_orderkey, date(o_orderdate) AS a, strftime('%Y-%m', o_orderdate) AS b, date('2024-01-31', '+1 month') AS c, unixepoch(o_orderdate) AS d, strftime('%w', o_orderdate) AS e, date(o_orderdate, 'start of month', '+1 day') AS f, julianday('2000-01-01') AS g FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m') AS b, '2024-03-02' AS c, epoch(o_orderdate)::BIGINT AS d, strftime(o_orderdate, '%w') AS e, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%d') AS f, 2451544.5::DOUBLE AS g FROM orders")
add("sql_current_time", "SELECT r_regionkey, length(CURRENT_DATE) AS a, length(CURRENT_TIME) AS b, length(CURRENT_TIMESTAMP) AS c, CURRENT_TIMESTAMP LIKE CURRENT_DATE || ' %' AS d FROM region", "SELECT r_regionkey, 10 AS a, 8 AS b, 19 AS c, true AS d FROM region")
add("sql_json_read", "SELECT event_id, props ->> 'k' AS a, props -> '$.k' AS b, json_extract(props, '$.k') AS c, json_type(props, '$.k') AS d, json_valid(props) AS e, json_array_length('[1,[2],3]') AS f FROM events",
    "SELECT event_id, props ->> '$.k' AS a, props -> '$.k' AS b, props ->> '$.k' AS c, 'integer' AS d, 1 AS e, 3 AS f FROM events")
add("sql_json_build", "SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name) AS a, json_array(n_nationkey, n_name, NULL, 1.5) AS b, json_set('{\"a\":1}', '$.b', n_regionkey) AS c, json_remove('[1,2,3]', '$[#-1]') AS d, json_patch('{\"a\":1}', '{\"a\":null,\"b\":2}') AS e, json('{ \"x\" : [1, 2] }') AS f, json_quote(n_name) AS g, json_insert('{\"a\":1}', '$.a', 5) AS h, json_replace('{\"a\":1}', '$.a', 5) AS i FROM nation",
    "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' AS a, '[' || n_nationkey || ',\"' || n_name || '\",null,1.5]' AS b, '{\"a\":1,\"b\":' || n_regionkey || '}' AS c, '[1,2]' AS d, '{\"b\":2}' AS e, '{\"x\":[1,2]}' AS f, '\"' || n_name || '\"' AS g, '{\"a\":1}' AS h, '{\"a\":5}' AS i FROM nation")
add("sql_json_more", "SELECT r_regionkey, json_error_position('{\"a\":1}') AS a, json_error_position('{\"a\":}') > 0 AS b, json_pretty('[1,{\"a\":2}]') AS c, json_valid('{bad') AS d FROM region", "SELECT r_regionkey, 0 AS a, true AS b, '[' || chr(10) || '    1,' || chr(10) || '    {' || chr(10) || '        \"a\": 2' || chr(10) || '    }' || chr(10) || ']' AS c, 0 AS d FROM region")
_JSONB = [
    ("a", "jsonb('{ \"a\" : 1 }')", '{"a":1}'), ("b", "jsonb_array(1, 'x', NULL)", '[1,"x",null]'), ("c", "jsonb_object('k', 1)", '{"k":1}'), ("d", "jsonb_remove('{\"a\":1,\"b\":2}', '$.a')", '{"b":2}'), ("e", "jsonb_set('{\"a\":1}', '$.a', 2)", '{"a":2}'),
    ("f", "jsonb_insert('{\"a\":1}', '$.b', 2)", '{"a":1,"b":2}'), ("g", "jsonb_replace('{\"a\":1}', '$.a', 3)", '{"a":3}'), ("h", "jsonb_patch('{\"a\":1}', '{\"c\":2}')", '{"a":1,"c":2}'), ("i", "jsonb_extract('{\"a\":[1,2]}', '$.a[#-1]')", "2"), ("j", "jsonb_extract('{\"a\":[1,2]}', '$.a')", "[1,2]"),
]
_JSONB_SQL = f"SELECT r_regionkey, {', '.join(f'{x} AS {n}' for n, x, _ in _JSONB)} FROM region"


@R.add("sql_jsonb", f"SELECT r_regionkey, {', '.join(chr(39) + v + chr(39) + ' AS ' + n for n, _, v in _JSONB)} FROM region")
def _(t):
    from pyspark.sql import functions as F

    return database(t, _JSONB_SQL).query(_JSONB_SQL).select("r_regionkey", *(F.to_json(n).alias(n) for n, _, _ in _JSONB))


add("sql_unistr", "SELECT r_regionkey, unistr('a\\0041\\+01F600') AS a, unistr_quote('it''s') AS b, unistr_quote(NULL) AS c FROM region", "SELECT r_regionkey, 'aA' || chr(128512) AS a, '''it''''s''' AS b, 'NULL' AS c FROM region")
add("sql_random", "SELECT r_regionkey, typeof(random()) AS a, length(randomblob(5)) AS b, ceiling(1.2) AS c, random() = random() AS d FROM region", "SELECT r_regionkey, 'integer' AS a, 5 AS b, 2.0::DOUBLE AS c, false AS d FROM region")
add("sql_maths", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS a, round(ln(abs(s_acctbal) + 1), 6) AS b, sqrt(-1) AS c, round(power(2, 0.5), 6) AS d, sign(s_acctbal) AS e, floor(s_acctbal) AS f, trunc(s_acctbal) AS g, mod(7, 3) AS h, round(log(2, 8), 6) AS i, round(atan2(1, 2), 6) AS j FROM supplier",
    "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS a, round(ln(abs(s_acctbal) + 1), 6) AS b, NULL::DOUBLE AS c, round(power(2, 0.5), 6) AS d, sign(s_acctbal) AS e, floor(s_acctbal) AS f, trunc(s_acctbal) AS g, 1.0 AS h, 3.0 AS i, round(atan2(1, 2), 6) AS j FROM supplier")
add("sql_row_values", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (2, 10) OR (n_regionkey, n_name) IN (SELECT r_regionkey, 'NATION_1' FROM region)", "SELECT n_nationkey FROM nation WHERE n_regionkey > 2 OR (n_regionkey = 2 AND n_nationkey > 10) OR n_name = 'NATION_1'")
add("sql_collate", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE OR c_name || '  ' = 'x' COLLATE RTRIM", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")

# Joins and subqueries --------------------------------------------------------------------------------------------

add("sql_join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer AS c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 150000")
add("sql_join_left_where", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_acctbal < 500")
add("sql_join_full", "SELECT n_nationkey, s_suppkey FROM nation FULL OUTER JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
add("sql_join_right_using", "SELECT k, a.v AS x, b.v AS y FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a RIGHT JOIN (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey > 9) b USING (k)")
add("sql_join_natural", "SELECT n_name, z FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS z FROM nation WHERE n_nationkey < 9)")
add("sql_join_cross_theta", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey")
add("sql_join_many", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name")
add("sql_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = customer.c_custkey AND o_orderstatus = 'P')")
add("sql_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
add("sql_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region)")
add("sql_view_scan", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders NOT INDEXED WHERE o_orderstatus = 'F'", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_orderstatus = 'F'")

# Aggregates ------------------------------------------------------------------------------------------------------

add("sql_group_having", "SELECT o_orderstatus AS s, o_orderpriority, count(*) AS n, sum(o_custkey) AS k, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY s, 2 HAVING n > 10 AND sum(o_custkey) > 0", sums="k")
add("sql_having_without_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 5")
add("sql_aggregate_forms", "SELECT c_nationkey, total(c_custkey) AS t, group_concat(c_custkey, ';' ORDER BY c_custkey DESC) AS g, median(c_acctbal) AS m, count(DISTINCT c_mktsegment) AS d, count(*) FILTER (WHERE c_acctbal < 0) AS f, percentile_disc(c_acctbal, 0.5) AS p FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, sum(c_custkey)::DOUBLE AS t, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey DESC) AS g, median(c_acctbal) AS m, count(DISTINCT c_mktsegment) AS d, count(*) FILTER (WHERE c_acctbal < 0) AS f, quantile_disc(c_acctbal, 0.5) AS p FROM customer GROUP BY c_nationkey")
add("sql_json_aggregates", "SELECT n_regionkey, json_group_array(n_nationkey ORDER BY n_nationkey) AS a, json_group_array(n_name ORDER BY n_name) AS b FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS a, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS b FROM nation GROUP BY n_regionkey")
add("sql_bare_column", "SELECT o_orderstatus, o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")

# Windows ---------------------------------------------------------------------------------------------------------

_G = "PARTITION BY o_orderpriority ORDER BY o_custkey"
add("sql_window_ranking", "SELECT o_orderkey, row_number() OVER w AS a, rank() OVER v AS b, dense_rank() OVER v AS c, ntile(4) OVER w AS d, lag(o_orderkey, 2) OVER w AS e, first_value(o_orderkey) OVER w AS f FROM orders WINDOW v AS (PARTITION BY o_orderstatus ORDER BY o_custkey), w AS (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey)")
add("sql_window_frames", f"SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) AS a, count(*) OVER ({_G} RANGE BETWEEN 5 PRECEDING AND UNBOUNDED FOLLOWING) AS b, sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS 2 PRECEDING) AS c FROM orders", sums="a c")
add("sql_window_groups", f"SELECT o_orderkey, count(*) OVER ({_G} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a, sum(o_custkey) OVER ({_G} GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, max(o_custkey) OVER ({_G} GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM orders WHERE o_orderkey % 2 = 0", sums="b")
add("sql_window_exclude", f"SELECT o_orderkey, sum(o_custkey) OVER ({_G} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a, count(*) OVER ({_G} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS b, min(o_custkey) OVER ({_G} RANGE BETWEEN 9 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS c, count(*) OVER ({_G}, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS d FROM orders", sums="a")
add("sql_window_filter_total", "SELECT n_nationkey, total(n_nationkey) OVER (PARTITION BY n_regionkey) AS a, sum(n_nationkey) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS b, group_concat(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c FROM nation",
    "SELECT n_nationkey, (sum(n_nationkey) OVER (PARTITION BY n_regionkey))::DOUBLE AS a, sum(n_nationkey) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS b, string_agg(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS c FROM nation", sums="b")
add("sql_window_json", "SELECT n_nationkey, json_group_object(n_name, n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS a, json_group_array(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation",
    "SELECT n_nationkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '}' AS a, '[' || string_agg('\"' || n_name || '\"', ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS b FROM nation")

# Sets, order and common table expressions ------------------------------------------------------------------------

add("sql_sets", "SELECT n_regionkey AS k FROM nation UNION SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT 3", "((SELECT n_regionkey AS k FROM nation UNION SELECT s_suppkey FROM supplier) INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT 3")
add("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 10 OFFSET 5")
add("sql_order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k LIMIT 7", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 7")
add("sql_cte", "WITH big(k, p) AS NOT MATERIALIZED (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), s AS MATERIALIZED (SELECT k, count(*) AS n FROM big GROUP BY k) SELECT k, n FROM s WHERE n > 2")
add("sql_cte_recursive", "WITH RECURSIVE c(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM c WHERE n < 12) SELECT n, f FROM c")
add("sql_values", "VALUES (1, 'a'), (2, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(column1, column2)")
add("sql_derived", "SELECT s, n FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1) WHERE n > 1")
