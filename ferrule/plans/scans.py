"""Scans, projections, predicates and operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import nulls
from ferrule.functions import operators as op
from ferrule.operators import relational as rel
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("scan_seq", "SELECT * FROM nation")
def _(t):
    return t("nation")


@R.add("scan_filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01' AND l_discount >= 0.05")
def _(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return t("lineitem").where((F.col("l_shipdate") >= day("1995-01-01")) & (F.col("l_shipdate") < day("1995-02-01")) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("scan_index_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(t):
    return t("orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@R.add("scan_index_union", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 2, 3) OR c_nationkey = 5 OR c_custkey BETWEEN 2 AND 10")
def _(t):
    return t("customer").where(F.col("c_custkey").isin(1, 2, 3) | (F.col("c_nationkey") == 5) | F.col("c_custkey").between(2, 10)).select("c_custkey", "c_name")


@R.add("scan_derived", "SELECT big, n FROM (SELECT o_custkey AS big, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n >= 3")
def _(t):
    return t("orders").groupBy(F.col("o_custkey").alias("big")).agg(F.count("*").alias("n")).where("n >= 3")


@R.add("scan_view", "SELECT id, label FROM (SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_regionkey = 1)")
def _(t):
    view = t("nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    return view.toDF("id", "label")


@R.add("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)")
def _(t):
    return rel.values(t("region").sparkSession, [(1, "a"), (2, "b"), (3, None)])


@R.add("scan_single_row", "SELECT 1 + 1 AS two, 'x' AS x")
def _(t):
    return rel.single_row(t("region").sparkSession).select((F.lit(1) + 1).alias("two"), F.lit("x").alias("x"))


@R.add("scan_rowid", "SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS rowid, c_name FROM customer")
def _(t):
    return rel.with_rowid(t("customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"]).select("rowid", "c_name")


@R.add("project_expressions", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_orderkey AS k FROM lineitem WHERE l_quantity < 3")
def _(t):
    return t("lineitem").where("l_quantity < 3").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_orderkey").alias("k"))


@R.add("where_alias", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE p_retailprice * 2 > 2500")
def _(t):
    return rel.where_alias(t("part"), {"twice": F.col("p_retailprice") * 2}, F.col("twice") > 2500).select("p_partkey", "twice")


@R.add("distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def _(t):
    return t("part").select("p_brand", "p_size").distinct()


@R.add("distinct_aggregate", "SELECT DISTINCT count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).select("n").distinct()


@R.add("pred_compare_logic", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size >= 40) AND p_size <> 20 AND p_retailprice > 1000")
def _(t):
    s = F.col("p_size")
    return t("part").where(~((s < 10) | (s >= 40)) & (s != 20) & (F.col("p_retailprice") > 1000)).select("p_partkey")


@R.add("pred_like", "SELECT p_partkey, p_name ILIKE '%A_e%' AS folded, p_name LIKE '%a%' AS exact, p_name ILIKE 'x!%%' ESCAPE '!' AS escaped FROM part")
def _(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", op.like(n, "%A_e%").alias("folded"), op.like(n, "%a%", case_sensitive=True).alias("exact"), op.like(n, "x!%%", "!").alias("escaped"))


@R.add("pred_glob", "SELECT p_partkey, p_type GLOB '*[A-M]*' AS a, p_type GLOB 'E*' AS b, p_type GLOB '?C*' AS c FROM part")
def _(t):
    x = F.col("p_type")
    return t("part").select("p_partkey", op.glob(x, "*[A-M]*").alias("a"), op.glob(x, "E*").alias("b"), op.glob(x, "?C*").alias("c"))


@R.add("pred_regexp", "SELECT p_partkey, regexp_matches(p_name, '^[a-m].*e') AS a, regexp_matches(p_brand, '[1-3]$') AS b FROM part")
def _(t):
    return t("part").select("p_partkey", op.regexp(F.col("p_name"), "^[a-m].*e").alias("a"), op.regexp(F.col("p_brand"), "[1-3]$").alias("b"))


@R.add("pred_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linenumber NOT BETWEEN 2 AND 6")
def _(t):
    return t("lineitem").where(F.col("l_quantity").between(10, 12) & ~F.col("l_linenumber").between(2, 6)).select("l_orderkey", "l_linenumber")


@R.add("pred_in", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_orderstatus NOT IN ('F', 'O') AS other, false AS none, CASE WHEN o_orderstatus = 'F' THEN true END AS maybe FROM orders")
def _(t):
    s = F.col("o_orderstatus")
    return t("orders").select("o_orderkey", op.is_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("urgent"), (~op.is_in(s, ["F", "O"])).alias("other"), op.is_in(s, []).alias("none"), op.is_in(s, ["F", None]).alias("maybe"))


_NULLS = "(VALUES (1, NULL, NULL), (2, NULL, 1), (3, 1, 1), (4, 1, 2), (5, 0, NULL)) v(id, a, b)"


def _nulls(t):
    return t("region").sparkSession.createDataFrame([(1, None, None), (2, None, 1), (3, 1, 1), (4, 1, 2), (5, 0, None)], "id long, a long, b long")


@R.add("pred_three_valued", f"SELECT id, a = b AS eq, a < b AS lt, a IS NULL AS n, a IS NOT NULL AS nn, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS nd, a = 1 AND b = 1 AS conj, a = 1 OR b = 1 AS disj, NOT a = 1 AS neg, a IN (1, NULL) AS i FROM {_NULLS}")
def _(t):
    a, b = F.col("a"), F.col("b")
    return _nulls(t).select("id", (a == b).alias("eq"), (a < b).alias("lt"), a.isNull().alias("n"), a.isNotNull().alias("nn"), op.is_distinct(a, b).alias("d"), a.eqNullSafe(b).alias("nd"), ((a == 1) & (b == 1)).alias("conj"), ((a == 1) | (b == 1)).alias("disj"), (~(a == 1)).alias("neg"), op.is_in(a, [1, None]).alias("i"))


@R.add("pred_truthy", f"SELECT id, coalesce(a <> 0, false) AS t, coalesce(a = 0, false) AS f, NOT coalesce(a <> 0, false) AS nt, b <> 0 AS bare FROM {_NULLS}")
def _(t):
    a = F.col("a")
    return _nulls(t).select("id", op.is_true(a).alias("t"), op.is_false(a).alias("f"), (~op.is_true(a)).alias("nt"), op.truthy(F.col("b")).alias("bare"))


@R.add("pred_row_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity, l_linenumber) < (2, 3) AND (l_returnflag, l_linestatus) = ('N', 'O')")
def _(t):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return t("lineitem").where(op.row_compare([q, n], "<", [2, 3]) & op.row_compare([F.col("l_returnflag"), F.col("l_linestatus")], "=", ["N", "O"])).select("l_orderkey", "l_linenumber")


@R.add("op_arithmetic", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS d, l_orderkey % 7 AS m, (-l_orderkey) // 7 AS nd, (-l_orderkey) % 7 AS nm, NULL::BIGINT AS z, NULL::BIGINT AS mz, l_quantity / l_linenumber AS r, -l_linenumber AS neg FROM lineitem")
def _(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", op.int_div(k, 7).alias("d"), op.mod(k, 7).alias("m"), op.int_div(-k, 7).alias("nd"), op.mod(-k, 7).alias("nm"), op.int_div(k, 0).alias("z"), op.mod(k, 0).alias("mz"), op.real_div(F.col("l_quantity"), n).alias("r"), (-n).alias("neg"))


@R.add("op_overflow", "SELECT 9223372036854775807::DOUBLE + 1 AS a, (-9223372036854775808)::DOUBLE - 1 AS s, 9223372036854775807::DOUBLE * 2 AS m, 7::DOUBLE AS small")
def _(t):
    one = rel.single_row(t("region").sparkSession)
    top, low = F.lit(op.MAX_LONG), F.lit(op.MIN_LONG)
    return one.select(op.add(top, F.lit(1).cast("long")).alias("a"), op.subtract(low, F.lit(1).cast("long")).alias("s"), op.multiply(top, F.lit(2).cast("long")).alias("m"), op.add(F.lit(3).cast("long"), F.lit(4).cast("long")).alias("small"))


@R.add("op_bits", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, ~o_orderkey AS n, o_orderkey * 8 AS l, o_orderkey >> 2 AS r, 0::BIGINT AS gone, -1::BIGINT AS minus, o_orderkey >> 1 AS rev FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(5).alias("o"), F.bitwise_not(k).alias("n"), op.shift_left(k, 3).alias("l"), op.shift_right(k, 2).alias("r"), op.shift_left(k, 64).alias("gone"), op.shift_right(F.lit(-5), 70).alias("minus"), op.shift_left(k, -1).alias("rev"))


@R.add("op_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment || c_nationkey AS s, NULL::VARCHAR AS n, '2.5' AS half, '1500000000000000.0' AS big, '0.0001' AS small FROM customer")
def _(t):
    real = lambda x: op.real_text(F.lit(x))
    return t("customer").select("c_custkey", op.concat(F.col("c_name"), "/", F.col("c_mktsegment"), F.col("c_nationkey")).alias("s"), op.concat(F.col("c_name"), F.lit(None)).alias("n"), real(2.5).alias("half"), real(1.5e15).alias("big"), real(1e-4).alias("small"))


@R.add("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS s, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS w FROM part")
def _(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", nulls.case(None, [(s < 10, "small"), (s < 30, "medium")], "large").alias("s"), nulls.case(s, [(1, "one"), (2, "two")]).alias("w"))


@R.add("cast_prefix", "SELECT * FROM (VALUES ('12abc', 12::BIGINT, 12.0), ('  7', 7, 7.0), ('abc', 0, 0.0), ('', 0, 0.0), ('-3.9x', -3, -3.9), ('1e3', 1, 1000.0), ('99999999999999999999', 9223372036854775807, 1e20), (NULL, NULL, NULL)) v(s, i, r)")
def _(t):
    rows = [("12abc",), ("  7",), ("abc",), ("",), ("-3.9x",), ("1e3",), ("99999999999999999999",), (None,)]
    s = F.col("s")
    return t("region").sparkSession.createDataFrame(rows, "s string").select("s", op.cast_integer(s).alias("i"), op.cast_real(s).alias("r"))


@R.add("cast_columns", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_orderkey::DOUBLE AS r, o_orderkey::VARCHAR AS s FROM orders")
def _(t):
    return t("orders").select("o_orderkey", op.cast_integer(F.col("o_totalprice"), "double").alias("i"), op.cast_real(F.col("o_orderkey"), "other").alias("r"), op.cast_text(F.col("o_orderkey")).alias("s"))


@R.add("collate_nocase", "SELECT lower(p_type) AS k, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(op.collate(op.fold(F.upper("p_type")), "NOCASE").alias("k")).agg(F.count("*").alias("n"))
