"""Sorting, limits, set operations and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions.operators import collate
from ferrule.operators import relational as rel
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("order_nulls", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END ASC NULLS FIRST, c_custkey) AS a, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey DESC NULLS LAST) AS d FROM customer")
def _(t):
    x, k = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.col("c_custkey")
    up = rel.with_rowid(t("customer").select("c_custkey", "c_acctbal"), [rel.order_key(x), rel.order_key(k, nulls="last")], "a")  # its SQL's default for the second key
    return rel.with_rowid(up, [rel.order_key(x, True), rel.order_key(k, True)], "d").drop("c_acctbal")


@R.add("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def _(t):
    return rel.limit(t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 20, 5)


@R.add("order_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def _(t):
    return rel.limit(t("part").select("p_partkey", "p_retailprice").orderBy(rel.order_key(F.col("p_retailprice"), True), "p_partkey"), 10)


@R.add("order_negative_limit", "SELECT n_nationkey FROM nation")
def _(t):
    return rel.limit(t("nation").select("n_nationkey"), -1, -5)


@R.add("order_expression_collate", "SELECT n_name FROM nation ORDER BY lower(n_name) DESC, length(n_name) LIMIT 7")
def _(t):
    return t("nation").select("n_name").orderBy(rel.order_key(collate(F.col("n_name"), "NOCASE"), True), F.length("n_name")).limit(7)


@R.add("setop_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return rel.compound(t("customer").select(F.col("c_nationkey").alias("k")), ("union all", t("supplier").select("s_nationkey")))


@R.add("setop_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return rel.compound(t("customer").select(F.col("c_nationkey").alias("k")), ("union", t("supplier").select("s_nationkey")))


@R.add("setop_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(t):
    return rel.compound(t("orders").select(F.col("o_custkey").alias("k")), ("intersect", t("customer").where("c_acctbal > 5000").select("c_custkey")))


@R.add("setop_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return rel.compound(t("customer").select(F.col("c_custkey").alias("k")), ("except", t("orders").select("o_custkey")))


@R.add("setop_left_associative", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    first = t("nation").select(F.col("n_nationkey").alias("k"))
    return rel.compound(first, ("union", t("region").select(F.col("r_regionkey") + 100)), ("intersect", t("supplier").select("s_nationkey")))


@R.add("setop_order_limit", "SELECT k FROM (SELECT n_name AS k FROM nation UNION SELECT r_name FROM region) ORDER BY k LIMIT 8")
def _(t):
    return rel.compound(t("nation").select(F.col("n_name").alias("k")), ("union", t("region").select("r_name"))).orderBy("k").limit(8)


@R.add("cte_chain", "WITH big(cust, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY 1), top AS (SELECT max(n) AS n FROM big) SELECT cust, big.n FROM big JOIN top ON big.n = top.n")
def _(t):
    big = t("orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n"))
    return big.join(F.broadcast(big.agg(F.max("n").alias("n"))), "n").select("cust", "n")


@R.add("cte_values", "WITH v(k, w) AS (VALUES (1, 10), (2, 20)) SELECT n_name, w FROM nation JOIN v ON n_regionkey = k")
def _(t):
    v = rel.values(t("nation").sparkSession, [(1, 10), (2, 20)], ["k", "w"])
    return t("nation").join(v, F.col("n_regionkey") == F.col("k")).select("n_name", "w")


@R.add("cte_recursive", "WITH RECURSIVE s(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 20) SELECT n, total FROM s")
def _(t):
    return t("region").sparkSession.sql("WITH RECURSIVE s(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 20) SELECT n, total FROM s")
