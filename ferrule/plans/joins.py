"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import relational as rel
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@R.add("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def _(t):
    o = t("orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@R.add("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def _(t):
    s = t("supplier").where("s_acctbal > 5000")
    return s.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@R.add("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20")
def _(t):
    return t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey") * 20, "full").select("c_custkey", "s_suppkey")


@R.add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@R.add("join_natural", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = t("nation").withColumnRenamed("n_regionkey", "regionkey")
    return rel.natural_join(n, t("region").withColumnRenamed("r_regionkey", "regionkey")).select("n_name", "r_name")


@R.add("join_using", "SELECT coalesce(c.nationkey, s.nationkey) AS nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM customer WHERE c_nationkey < 15) c FULL JOIN (SELECT s_nationkey AS nationkey FROM supplier WHERE s_nationkey > 10) s ON c.nationkey = s.nationkey GROUP BY 1")
def _(t):
    c = t("customer").where("c_nationkey < 15").select(F.col("c_nationkey").alias("nationkey"))
    s = t("supplier").where("s_nationkey > 10").select(F.col("s_nationkey").alias("nationkey"))
    return rel.join_using(c, s, ["nationkey"], "full").groupBy("nationkey").agg(F.count("*").alias("n"))


@R.add("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, F.expr("a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@R.add("join_multi", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).groupBy("l_orderkey").agg(F.sum("net").alias("net"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = t("customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    out = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy("r_name").agg(F.round(F.sum("net"), 2).alias("revenue"))


@R.add("join_derived", "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def _(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "n")


@R.add("join_values", "SELECT n_name, label FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) v(k, label) ON n_regionkey = k")
def _(t):
    v = rel.values(t("nation").sparkSession, [(0, "zero"), (1, "one")], ["k", "label"])
    return t("nation").join(v, F.col("n_regionkey") == F.col("k")).select("n_name", "label")


@R.add("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(t):
    o = t("orders").where("o_orderstatus = 'F'").select("o_custkey")
    return rel.semi_join(t("customer"), o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@R.add("semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    lines = t("lineitem").where("l_quantity > 45").select("l_partkey")
    return rel.semi_join(t("part"), lines, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey")


@R.add("semi_in_row", "SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey) IN (SELECT c_nationkey, c_custkey FROM customer)")
def _(t):
    return rel.semi_join(t("supplier"), t("customer"), (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") == F.col("c_custkey"))).select("s_suppkey")


@R.add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return rel.anti_join(t("customer"), t("orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@R.add("not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(t):
    return rel.not_in(t("customer"), "c_custkey", t("orders").where("o_totalprice > 200000"), "o_custkey").select("c_custkey")


@R.add("not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey > 5 THEN o_custkey END FROM orders)")
def _(t):
    y = t("orders").select(F.when(F.col("o_orderkey") > 5, F.col("o_custkey")).alias("y"))
    return rel.not_in(t("customer"), "c_custkey", y, "y").select("c_custkey")


@R.add("scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.3 FROM part)")
def _(t):
    mean = rel.scalar(t("part").agg((F.avg("p_retailprice") * 1.3).alias("mean")))
    return t("part").join(F.broadcast(mean), F.col("p_retailprice") > F.col("mean")).select("p_partkey", "p_retailprice")


@R.add("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def _(t):
    top = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t("customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top")


@R.add("correlated_compare", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    low = lines.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("low"))
    return lines.join(low, "l_partkey").where("l_quantity < low").select("l_orderkey", "l_linenumber")
