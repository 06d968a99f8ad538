"""Catalog relations and pragma table functions over a database of the driver's tables, and batch time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.database import ColumnDef, Database, Index, Table
from ferrule.plans.registry import Registry
from ferrule.streaming import windows as stream

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _db(t) -> Database:
    db = Database(t("region").sparkSession)
    db.attach(Table("region", (ColumnDef("r_regionkey", "INTEGER"), ColumnDef("r_name", "TEXT")), primary_key=("r_regionkey",)), t("region"))
    db.attach(Table("nation", (ColumnDef("n_nationkey", "INTEGER"), ColumnDef("n_name", "TEXT", not_null=True), ColumnDef("n_regionkey", "INTEGER"))), t("nation"))
    db.create_index(Index("nation_name", "nation", ("n_name",), unique=True))
    return db


@R.add("pragma_table_info", "SELECT * FROM (VALUES (0::BIGINT, 'n_nationkey', 'INTEGER', 0::BIGINT, NULL::VARCHAR, 0::BIGINT), (1, 'n_name', 'TEXT', 1, NULL, 0), (2, 'n_regionkey', 'INTEGER', 0, NULL, 0)) v(cid, name, type, \"notnull\", dflt_value, pk)")
def _(t):
    return _db(t).pragma("table_info", "nation")


@R.add("pragma_index_info", "SELECT 0::BIGINT AS seqno, 1::BIGINT AS cid, 'n_name' AS name")
def _(t):
    return _db(t).pragma("index_info", "nation_name")


@R.add("catalog_master", "SELECT * FROM (VALUES ('table', 'region', 'region'), ('table', 'nation', 'nation'), ('index', 'nation_name', 'nation')) v(type, name, tbl_name)")
def _(t):
    return _db(t).table("sqlite_master").select("type", "name", "tbl_name")


@R.add("scan_indexed_by", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3' OR n_nationkey = 3")
def _(t):
    return _db(t).indexed_by("nation", "nation_name").where("n_name = 'NATION_3' OR n_nationkey = 3").select("n_nationkey")


@R.add("explain_query_plan", "SELECT true AS numbered, true AS filtered")
def _(t):
    db = _db(t)
    plan = db.explain(db.table("nation").where("n_regionkey = 1"))
    return plan.agg((F.count("*") == F.max("id") + 1).alias("numbered"), F.max(F.col("detail").contains("n_regionkey")).alias("filtered"))


@R.add("dml_transaction", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 77, 'kept'")
def _(t):
    db = _db(t)
    db.begin()
    db.insert("region", [(77, "kept")])
    db.savepoint("s")
    db.delete("region")
    db.rollback_to("s")
    db.delete("region", F.col("r_regionkey") == 1)
    db.commit()
    return db.table("region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@R.add("events_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    out = stream.windowed(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["event_type"])
    return out.select(F.date_format("begins", "yyyy-MM-dd HH:mm:ss").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))
