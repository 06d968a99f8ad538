"""Window queries: functions, frame families, EXCLUDE, FILTER and named windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import windows as win
from ferrule.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@R.add(
    "win_ranking",
    f"""SELECT o_orderkey, row_number() OVER {_W} AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS dr,
    round(percent_rank() OVER {_W}, 9) AS pr, round(cume_dist() OVER {_W}, 9) AS cd, ntile(3) OVER {_W} AS nt FROM orders""",
)
def _(t):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_orderstatus").orderBy("o_custkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(s).alias("rk"), F.dense_rank().over(s).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.ntile(3).over(w).alias("nt"))


@R.add(
    "win_values",
    f"""SELECT o_orderkey, lag(o_orderkey) OVER {_W} AS p, lead(o_orderkey, 2, -1) OVER {_W} AS n, first_value(o_totalprice) OVER {_W} AS f, last_value(o_totalprice) OVER {_W} AS l,
    nth_value(o_orderkey, 2) OVER {_W} AS second FROM orders""",
)
def _(t):
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), F.col("o_orderkey")
    return t("orders").select("o_orderkey", F.lag(k).over(w).alias("p"), F.lead(k, 2, -1).over(w).alias("n"), F.first_value("o_totalprice").over(w).alias("f"), F.last_value("o_totalprice").over(w).alias("l"), F.nth_value(k, 2).over(w).alias("second"))


@R.add(
    "win_aggregates",
    f"""SELECT o_orderkey, count(*) OVER {_W} AS n, sum(o_custkey) OVER {_W}::BIGINT AS s, round(avg(o_totalprice) OVER {_W}, 6) AS a, coalesce(sum(o_custkey::DOUBLE) OVER {_W}, 0.0) AS t, min(o_totalprice) OVER {_W} AS lo, max(o_totalprice) OVER {_W} AS hi,
    string_agg(o_orderkey::VARCHAR, ',') OVER {_W} AS g, '[' || string_agg(o_orderkey::VARCHAR, ',') OVER {_W} || ']' AS j FROM orders""",
)
def _(t):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), F.col("o_totalprice")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select("o_orderkey", F.count("*").over(w).alias("n"), F.sum(c).over(w).alias("s"), F.round(F.avg(p).over(w), 6).alias("a"), win.total_over(c, w).alias("t"), F.min(p).over(w).alias("lo"), F.max(p).over(w).alias("hi"), win.group_concat_over(k, w).alias("g"), win.json_group_array_over(k, w).alias("j"))


@R.add("win_filter", f"SELECT o_orderkey, sum(o_custkey) FILTER (WHERE o_orderstatus = 'O') OVER {_W}::BIGINT AS s, count(*) FILTER (WHERE o_totalprice > 100000) OVER {_W} AS n FROM orders")
def _(t):
    s = win.Spec(("o_custkey",), (F.col("o_orderdate"), F.col("o_orderkey")))
    out = win.over(t("orders"), "s", F.sum, F.col("o_custkey"), s, F.col("o_orderstatus") == "O")
    return win.over(out, "n", F.count, F.lit(1), s, F.col("o_totalprice") > 100000).select("o_orderkey", "s", "n")


@R.add("win_named", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS a, count(*) OVER (PARTITION BY o_orderpriority) AS b FROM orders")
def _(t):
    base = win.Spec(("o_orderpriority",))
    chained = base.extend((F.col("o_orderkey"),), ("o_orderkey",), unit="rows", low=-2, high=0)
    return t("orders").select("o_orderkey", F.sum("o_custkey").over(win.spec(chained)).alias("a"), F.count("*").over(win.spec(base)).alias("b"))


#: Every ROWS form: suffix, bounds, SQL.
_ROWS = [
    ("p_cr", -2, 0, "2 PRECEDING AND CURRENT ROW"), ("p_p", -3, -1, "3 PRECEDING AND 1 PRECEDING"), ("p_f", -1, 2, "1 PRECEDING AND 2 FOLLOWING"), ("p_uf", -1, None, "1 PRECEDING AND UNBOUNDED FOLLOWING"),
    ("cr", 0, 0, "CURRENT ROW AND CURRENT ROW"), ("cr_f", 0, 2, "CURRENT ROW AND 2 FOLLOWING"), ("cr_uf", 0, None, "CURRENT ROW AND UNBOUNDED FOLLOWING"), ("f_f", 1, 3, "1 FOLLOWING AND 3 FOLLOWING"),
    ("f_uf", 1, None, "1 FOLLOWING AND UNBOUNDED FOLLOWING"), ("up_cr", None, 0, "UNBOUNDED PRECEDING AND CURRENT ROW"), ("up_uf", None, None, "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"),
]


@R.add("frame_rows", "SELECT event_id, " + ", ".join(f"sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {sql})::BIGINT AS {n}" for n, _, _, sql in _ROWS) + " FROM events")
def _(t):
    order = (F.col("ts"), F.col("event_id"))
    return t("events").select("event_id", *(F.sum("user_id").over(win.spec(win.Spec(("event_type",), order, "rows", a, b))).alias(n) for n, a, b, _ in _ROWS))


_RANGE = [
    ("p_cr", -20, 0, "20 PRECEDING AND CURRENT ROW"), ("p_p", -30, -10, "30 PRECEDING AND 10 PRECEDING"), ("p_f", -10, 20, "10 PRECEDING AND 20 FOLLOWING"), ("p_uf", -5, None, "5 PRECEDING AND UNBOUNDED FOLLOWING"),
    ("up_p", None, -5, "UNBOUNDED PRECEDING AND 5 PRECEDING"), ("up_f", None, 5, "UNBOUNDED PRECEDING AND 5 FOLLOWING"), ("cr_f", 0, 10, "CURRENT ROW AND 10 FOLLOWING"), ("f_f", 5, 15, "5 FOLLOWING AND 15 FOLLOWING"),
    ("f_uf", 5, None, "5 FOLLOWING AND UNBOUNDED FOLLOWING"), ("cr", 0, 0, "CURRENT ROW AND CURRENT ROW"), ("cr_uf", 0, None, "CURRENT ROW AND UNBOUNDED FOLLOWING"),
]


@R.add("frame_range", "SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN {sql}) AS {n}" for n, _, _, sql in _RANGE) + " FROM events")
def _(t):
    return t("events").select("event_id", *(F.count("*").over(win.spec(win.Spec(("event_type",), (F.col("user_id"),), "range", a, b))).alias(n) for n, a, b, _ in _RANGE))


@R.add("frame_range_fraction", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice RANGE BETWEEN 10.5 PRECEDING AND 0.25 FOLLOWING) AS n FROM part")
def _(t):
    t("part").createOrReplaceTempView("_ferrule_part")
    return t("part").sparkSession.sql("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice RANGE BETWEEN 10.5D PRECEDING AND 0.25D FOLLOWING) AS n FROM _ferrule_part")


_GROUPS = [(n, a, b, sql) for n, a, b, sql in _ROWS]


@R.add("frame_groups", "SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN {sql}) AS {n}" for n, _, _, sql in _GROUPS) + " FROM events")
def _(t):
    spec = lambda a, b: win.Spec(("event_type",), (F.col("user_id"),), "groups", a, b)
    return win.over_all(t("events"), {n: (F.count, F.lit(1), spec(a, b)) for n, a, b, _ in _GROUPS}).select("event_id", *(n for n, *_ in _GROUPS))


@R.add("frame_groups_over", "SELECT event_id, sum(value) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0 AS positive, max(value) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM events")
def _(t):
    s = win.Spec(("event_type",), (F.col("user_id"),), "groups", -1, 1, keys=("user_id",))
    out = win.over(t("events"), "s", F.sum, F.col("value"), s)
    return win.over(out, "top", F.max, F.col("value"), s).select("event_id", (F.col("s") > 0).alias("positive"), "top")


_EXCLUDE = [("current_row", "CURRENT ROW"), ("grp", "GROUP"), ("ties", "TIES"), ("no_others", "NO OTHERS")]


@R.add("exclude_groups", "SELECT o_orderkey, " + ", ".join(f"sum(o_custkey) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {sql})::DOUBLE AS {n}" for n, sql in _EXCLUDE) + " FROM orders")
def _(t):
    out = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    for n, sql in _EXCLUDE:
        s = win.Spec(("o_orderstatus", "o_orderpriority"), (F.col("o_custkey"),), "groups", -1, 1, exclude=sql.lower(), keys=("o_custkey",))
        out = win.over(out, n, F.sum, F.col("o_custkey"), s)
    return out.select("o_orderkey", *(F.col(n).cast("double").alias(n) for n, _ in _EXCLUDE))


@R.add("exclude_running", "SELECT o_orderkey, " + ", ".join(f"sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {sql})::DOUBLE AS {n}" for n, sql in _EXCLUDE[:3]) + " FROM orders")
def _(t):
    out = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    for n, sql in _EXCLUDE[:3]:
        s = win.Spec(("o_orderpriority",), (F.col("o_custkey"),), "range", None, 0, exclude=sql.lower(), keys=("o_custkey",))
        out = win.excluded_sum(out, n, F.col("o_custkey"), s)
    return out.select("o_orderkey", *(n for n, _ in _EXCLUDE[:3]))
