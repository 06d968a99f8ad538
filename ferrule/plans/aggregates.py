"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import aggregates as agg
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def _(t):
    return (
        t("lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count("*").alias("n"),
        )
    )


@R.add("agg_global", "SELECT count(*) AS n, count(o_orderstatus) AS k, count(DISTINCT o_custkey) AS d, sum(o_orderkey)::BIGINT AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t("orders").agg(agg.count_rows().alias("n"), agg.count(F.col("o_orderstatus")).alias("k"), agg.count(F.col("o_custkey"), distinct=True).alias("d"), agg.sum_(F.col("o_orderkey")).alias("s"), F.round(agg.avg(p), 4).alias("a"), agg.min_(p).alias("lo"), agg.max_(p).alias("hi"))


@R.add("agg_empty", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s, 0.0::DOUBLE AS t, avg(o_totalprice) AS a, min(o_orderkey) AS lo, NULL::VARCHAR AS g FROM orders WHERE o_orderkey < 0")
def _(t):
    k = F.col("o_orderkey")
    return t("orders").where("o_orderkey < 0").agg(agg.count_rows().alias("n"), agg.sum_(k).alias("s"), agg.total(k).alias("t"), agg.avg(F.col("o_totalprice")).alias("a"), agg.min_(k).alias("lo"), agg.group_concat(F.col("o_orderstatus")).alias("g"))


@R.add("agg_total", "SELECT l_returnflag, coalesce(sum(l_linenumber::DOUBLE), 0.0) AS t, coalesce(sum(CASE WHEN l_linenumber > 100 THEN l_linenumber::DOUBLE END), 0.0) AS none FROM lineitem GROUP BY 1")
def _(t):
    n = F.col("l_linenumber")
    return t("lineitem").groupBy("l_returnflag").agg(agg.total(n).alias("t"), agg.total(n, n > 100).alias("none"))


@R.add("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey)::BIGINT AS s, round(avg(DISTINCT o_custkey), 6) AS a FROM orders GROUP BY 1")
def _(t):
    c = F.col("o_custkey")
    return t("orders").groupBy("o_orderpriority").agg(agg.count(c, True).alias("c"), agg.sum_(c, True).alias("s"), F.round(agg.avg(c, True), 6).alias("a"))


@R.add("agg_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '; ' ORDER BY n_nationkey) AS by_key, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS firsts FROM nation GROUP BY 1")
def _(t):
    n = F.col("n_name")
    return t("nation").groupBy("n_regionkey").agg(agg.group_concat(n).alias("names"), agg.string_agg(n, "; ", order=[F.col("n_nationkey")]).alias("by_key"), agg.group_concat(F.left(n, F.lit(1)), distinct=True).alias("firsts"))


@R.add("agg_median_percentile", "SELECT p_brand, median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.9) AS p90, quantile_cont(p_retailprice, 0.25) AS c25, quantile_disc(p_size, 0.5) AS d50 FROM part GROUP BY 1")
def _(t):
    p = F.col("p_retailprice")
    return t("part").groupBy("p_brand").agg(agg.median(p).alias("m"), agg.percentile(p, 90).alias("p90"), agg.percentile_cont(p, 0.25).alias("c25"), agg.percentile_disc("p_size", 0.5).cast("int").alias("d50"))


@R.add("agg_decimal_sum", "SELECT c_mktsegment, regexp_replace(sum(c_acctbal::DECIMAL(28, 10))::VARCHAR, '\\.?0+$', '') AS s FROM customer GROUP BY 1")
def _(t):
    return t("customer").groupBy("c_mktsegment").agg(agg.decimal_sum(F.col("c_acctbal")).alias("s"))


@R.add("agg_json_group", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS keys, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS names, '[' || string_agg(CASE WHEN n_nationkey > 10 THEN n_nationkey::VARCHAR ELSE 'null' END, ',' ORDER BY n_nationkey) || ']' AS some FROM nation GROUP BY 1")
def _(t):
    k, n = F.col("n_nationkey"), F.col("n_name")
    return t("nation").groupBy("n_regionkey").agg(agg.json_group_array(k, order=[k]).alias("keys"), agg.json_group_object(n, k).alias("names"), agg.json_group_array(F.when(k > 10, k), order=[k]).alias("some"))


@R.add("agg_jsonb_group", "SELECT n_regionkey, max(n_nationkey)::BIGINT AS last FROM nation GROUP BY 1")
def _(t):
    k = F.col("n_nationkey")
    out = t("nation").groupBy("n_regionkey").agg(agg.jsonb_group_array(k, order=[k]).alias("a"))
    return out.select("n_regionkey", F.array_max(F.variant_get("a", "$", "array<bigint>")).alias("last"))


@R.add("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, sum(o_totalprice) FILTER (WHERE o_custkey % 2 = 0) IS NULL AS none, min(o_orderkey) FILTER (WHERE o_totalprice < 50000) AS lo FROM orders GROUP BY 1")
def _(t):
    p = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(agg.count_rows(p > 100000).alias("big"), agg.sum_(p, where=F.col("o_custkey") % 2 == 0).isNull().alias("none"), agg.min_(F.col("o_orderkey"), p < 50000).alias("lo"))


@R.add("agg_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) >= 12 AND max(o_totalprice) > 200000")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).where("n >= 12 AND top > 200000")


@R.add("agg_group_expression", "SELECT year(o_orderdate)::INTEGER AS y, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t("orders").groupBy(F.year("o_orderdate").alias("y"), F.when(F.col("o_totalprice") > 150000, "high").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


@R.add("agg_bare_column", "SELECT n_regionkey, max(n_name) AS top, arg_max(n_nationkey, n_name) AS key_of_top, arg_min(n_nationkey, n_name) AS key_of_low FROM nation GROUP BY 1")
def _(t):
    n, k = F.col("n_name"), F.col("n_nationkey")
    return t("nation").groupBy("n_regionkey").agg(F.max(n).alias("top"), agg.bare(k, n).alias("key_of_top"), agg.bare(k, n, largest=False).alias("key_of_low"))


@R.add("agg_in_expression", "SELECT l_returnflag, CASE WHEN avg(l_quantity) > 25.4 THEN 'a' ELSE 'b' END AS c, (sum(l_linenumber) * 2 + count(*))::BIGINT AS e FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.when(F.avg("l_quantity") > 25.4, "a").otherwise("b").alias("c"), (F.sum("l_linenumber") * 2 + F.count("*")).alias("e"))


@R.add("agg_over_join", "SELECT r_name, count(*) AS n, sum(s_suppkey)::BIGINT AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s"))


@R.add("agg_events_by_day", "SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
