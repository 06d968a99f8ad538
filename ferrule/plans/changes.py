"""Data changes: the table after the statement, or the rows that RETURNING gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions.operators import lit
from ferrule.operators import dml
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("dml_insert_values", "SELECT * FROM region UNION ALL SELECT 10, 'OCEANIA' UNION ALL SELECT 11, NULL")
def _(t):
    region = t("region")
    rows = region.sparkSession.createDataFrame([(10, "OCEANIA"), (11, None)], "r_regionkey int, r_name string")
    return dml.insert(region, dml.fill(rows, region))


@R.add("dml_insert_defaults", "SELECT * FROM region UNION ALL SELECT 12, 'unnamed'")
def _(t):
    region = t("region")
    rows = region.sparkSession.createDataFrame([(12,)], "r_regionkey int")
    return dml.insert(region, dml.fill(rows, region, {"r_name": F.lit("unnamed")}))


@R.add("dml_insert_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT (n_nationkey + 100)::INTEGER, n_name || '2', n_regionkey FROM nation WHERE n_regionkey = 0")
def _(t):
    n = t("nation")
    new = n.where("n_regionkey = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat("n_name", F.lit("2")).alias("n_name"), "n_regionkey")
    return dml.insert(n, dml.fill(new, n))


_NEW = "(VALUES (3, 'three'), (4, 'four'), (100, 'hundred'), (NULL, 'nobody')) v(k, name)"


def _source(t):
    return t("region").sparkSession.createDataFrame([(3, "three"), (4, "four"), (100, "hundred"), (None, "nobody")], "n_nationkey int, n_name string")


def _target(t):
    return t("nation").select("n_nationkey", "n_name")


@R.add("dml_insert_or_ignore", f"SELECT n_nationkey, n_name FROM nation UNION ALL SELECT k, name FROM {_NEW} WHERE k IS NULL OR k NOT IN (SELECT n_nationkey FROM nation)")
def _(t):
    return dml.insert_or_ignore(_target(t), _source(t), ["n_nationkey"])[0]


@R.add("dml_insert_or_replace", f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 4, 100) UNION ALL SELECT k, name FROM {_NEW}")
def _(t):
    return dml.insert_or_replace(_target(t), _source(t), ["n_nationkey"])[0]


@R.add("dml_upsert", f"SELECT n_nationkey, CASE WHEN v.k IS NOT NULL AND n_nationkey <> 4 THEN n_name || '->' || v.name ELSE n_name END AS n_name FROM nation LEFT JOIN {_NEW} ON n_nationkey = v.k UNION ALL SELECT k, name FROM {_NEW} WHERE k IS NULL OR k NOT IN (SELECT n_nationkey FROM nation)")
def _(t):
    change = {"n_name": F.concat("n_name", F.lit("->"), "excluded_n_name")}
    return dml.upsert(_target(t), _source(t), ["n_nationkey"], change, F.col("n_nationkey") != 4)[0]


@R.add("dml_upsert_returning", "SELECT * FROM (VALUES (3, 'three'), (4, 'four'), (100, 'hundred'), (NULL, 'nobody')) v(n_nationkey, n_name)")
def _(t):
    return dml.upsert(_target(t), _source(t), ["n_nationkey"], {"n_name": F.col("excluded_n_name")})[1]


@R.add("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'POOR' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    return dml.update(t("customer"), {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("POOR")}, F.col("c_acctbal") < 0)[0]


@R.add("dml_update_swap_returning", "SELECT r_regionkey, r_name || r_regionkey AS r_name FROM region WHERE r_regionkey > 1")
def _(t):
    return dml.update(t("region"), {"r_name": F.concat("r_name", F.col("r_regionkey").cast("string"))}, F.col("r_regionkey") > 1)[1]


@R.add("dml_update_from", "SELECT n_nationkey, CASE WHEN r_regionkey <> 2 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    on = (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_regionkey") != 2)
    return dml.update_from(t("nation"), t("region"), on, {"n_name": F.col("r_name")}, ["n_nationkey"])[0]


@R.add("dml_update_limited", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 2) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update_limited(o, ["o_orderkey"], {"o_orderstatus": F.lit("X")}, F.col("o_orderstatus") == "O", [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, 2)[0].drop("o_totalprice")


@R.add("dml_delete", "SELECT s_suppkey, s_name FROM supplier WHERE NOT coalesce(s_acctbal < 1000, false)")
def _(t):
    return dml.delete(t("supplier"), F.col("s_acctbal") < 1000)[0].select("s_suppkey", "s_name")


@R.add("dml_delete_returning", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000")
def _(t):
    return dml.delete(t("supplier"), F.col("s_acctbal") < 1000)[1].select("s_suppkey")


@R.add("dml_delete_limited", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey < 500 ORDER BY o_totalprice, o_orderkey LIMIT 7)")
def _(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return dml.delete_limited(o, ["o_orderkey"], F.col("o_custkey") < 500, [F.asc("o_totalprice"), F.asc("o_orderkey")], 7)[0].select("o_orderkey")


@R.add("ddl_create_table_as", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    from ferrule.session import stage

    return stage(t("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), "table")


@R.add("ddl_alter_table", "SELECT r_regionkey AS id, NULL::VARCHAR AS note, 5 AS level FROM region")
def _(t):
    return t("region").withColumnRenamed("r_regionkey", "id").drop("r_name").withColumns({"note": F.lit(None).cast("string"), "level": lit(5)})


@R.add("ddl_generated_column", "SELECT p_partkey, p_size, p_size + 1 AS plus_one FROM part")
def _(t):
    like = t("part").select("p_partkey", "p_size", F.lit(0).alias("plus_one"))
    return dml.fill(t("part").select("p_partkey", "p_size"), like, generated={"plus_one": F.col("p_size") + 1})


@R.add("constraint_check", "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal >= 0)")
def _(t):
    return dml.check_violations(t("supplier"), F.col("s_acctbal") >= 0).select("s_suppkey")


@R.add("constraint_unique", "SELECT c_nationkey, c_mktsegment, count(*) AS count FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return dml.unique_violations(t("customer"), ["c_nationkey", "c_mktsegment"])


@R.add("constraint_foreign_key", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return dml.foreign_key_violations(t("orders"), ["o_custkey"], t("customer").where("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey")
