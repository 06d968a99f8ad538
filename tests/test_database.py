"""Database statements, constraints, triggers, transactions, pragmas and files."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from ferrule.database import ColumnDef, ConstraintError, Database, ForeignKey, Index, Table, Trigger
from ferrule.operators import relational as rel
from ferrule.sources.sqlite_file import Range, SqliteReader, SqliteSource, ship_file, write_table
from ferrule.streaming import windows as stream


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.create_table(Table("users", (ColumnDef("id", "INTEGER"), ColumnDef("name", "TEXT", not_null=True), ColumnDef("age", "INTEGER", default="18"), ColumnDef("next", "INTEGER", generated="age + 1")), primary_key=("id",), unique=(("name",),), checks=("age >= 0",)))
    d.insert("users", [(1, "ann", 30), (2, "bob", 20)])
    return d


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_insert_defaults_generated_and_ids(db):
    out = db.insert("users", [("cid",)], columns=["name"])
    assert rows(out) == [(3, "cid", 18, 19)] and db.last_insert_rowid == 3 and db.changes == 1 and db.total_changes == 3
    with pytest.raises(ValueError):
        db.insert("users", [(9, 9)], columns=["id", "next"])
    with pytest.raises(ValueError):
        db.insert("users", [(1, 2)], columns=["id"])


@pytest.mark.parametrize("row", [(1, "new", 1), (5, "ann", 1), (5, None, 1), (5, "x", -1)])
def test_constraints_stop_a_statement(db, row):
    before = rows(db.table("users"))
    with pytest.raises(ConstraintError):
        db.insert("users", [row])
    assert rows(db.table("users")) == before


def test_repeated_keys_count_in_the_order_of_input(db):
    db.insert("users", [(8, "b", 1), (8, "a", 2)], on_conflict=["id"])
    assert rows(db.table("users").where("id = 8"), "name") == [("b",)]
    db.insert("users", [(9, "z", 1), (9, "y", 2)], conflict="replace")
    assert rows(db.table("users").where("id = 9"), "name") == [("y",)]
    db.insert("users", [(10, "x", 1), (10, "w", 2), (10, "v", 3), (1, "q", 5)], on_conflict=["id"], set_={"age": F.col("age") * 10 + F.col("excluded_age")})
    assert rows(db.table("users").where("id in (1, 10)"), "id", "name", "age") == [(1, "ann", 305), (10, "x", 123)] and db.changes == 4


def test_limits_without_a_key(db, spark):
    db.execute("CREATE TABLE bag (a INT, b TEXT); INSERT INTO bag VALUES (1, 'x'), (1, 'x'), (NULL, NULL), (2, NULL)")
    db.execute("DELETE FROM bag ORDER BY a LIMIT 1")
    assert sorted(rows(db.table("bag")), key=str) == [(1, "x"), (1, "x"), (2, None)]
    db.execute("DELETE FROM bag WHERE a = 1 LIMIT 1; UPDATE bag SET b = 'new' LIMIT 1")
    assert sorted(rows(db.table("bag")), key=str) == [(1, "new"), (2, None)]


@pytest.mark.parametrize("action, want", [("CASCADE", [(1, 2), (2, 3), (3, None)]), ("SET NULL", [(1, None), (2, None), (3, None)]), ("SET DEFAULT", [(1, 3), (2, 3), (3, None)])])
def test_on_update_actions(spark, action, want):
    d = Database(spark)
    d.execute(f"""PRAGMA foreign_keys = ON; CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (k INTEGER, p INTEGER DEFAULT 3 REFERENCES p (id) ON DELETE CASCADE ON UPDATE {action} MATCH SIMPLE);
        INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL); UPDATE p SET id = id + 1""")
    assert sorted(rows(d.table("c")), key=str) == want
    assert d.pragma("foreign_key_list", "c").first()["match"] == "SIMPLE"


def test_restricted_and_deferred_keys(spark):
    d = Database(spark)
    d.execute("""PRAGMA foreign_keys = ON; CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (p INTEGER REFERENCES p (id)); CREATE TABLE l (p INTEGER REFERENCES p (id) DEFERRABLE INITIALLY DEFERRED);
        INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1)""")
    for sql in ("UPDATE p SET id = 9 WHERE id = 1", "DELETE FROM p WHERE id = 1", "INSERT INTO c VALUES (7)", "INSERT INTO l VALUES (7)"):
        with pytest.raises(ConstraintError):
            d.execute(sql)
    d.execute("UPDATE p SET id = 9 WHERE id = 2; BEGIN; INSERT INTO l VALUES (7); INSERT INTO p VALUES (7); COMMIT; BEGIN; INSERT INTO l VALUES (8)")
    with pytest.raises(ConstraintError):
        d.execute("COMMIT")
    d.execute("ROLLBACK")
    assert rows(d.table("l")) == [(7,)]


def test_null_passes_check(db):
    assert rows(db.insert("users", [(7, "n", None)])) == [(7, "n", None, None)]


def test_conflicts(db):
    db.insert("users", [(1, "x", 1), (4, "d", 4)], conflict="ignore")
    assert rows(db.table("users"), "id", "name") == [(1, "ann"), (2, "bob"), (4, "d")]
    db.insert("users", [(1, "bob", 5)], conflict="replace")
    assert rows(db.table("users"), "id", "name") == [(1, "bob"), (4, "d")]
    db.insert("users", [(4, "e", 50), (6, "f", 6)], on_conflict=["id"], set_={"age": F.col("age") + F.col("excluded_age")})
    assert rows(db.table("users"), "id", "name", "age") == [(1, "bob", 5), (4, "d", 54), (6, "f", 6)]
    db.insert("users", [(4, "zzz", 1)], on_conflict=["id"])
    assert db.changes == 0
    with pytest.raises(ValueError):
        db.insert("users", [(4, "q", 1)], on_conflict=["age"])


def test_update_and_delete(db, spark):
    assert rows(db.update("users", {"age": F.col("age") * 2}, F.col("id") == 1)) == [(1, "ann", 60, 61)]
    source = spark.createDataFrame([(2, 99), (2, 98)], "uid long, new_age long")
    assert rows(db.update("users", {"age": F.col("new_age")}, source=source, on=F.col("id") == F.col("uid"))) == [(2, "bob", 98, 99)]
    assert rows(db.update("users", {"age": 1}, order=[F.desc("id")], limit=1), "id") == [(2,)]
    assert rows(db.delete("users", order=[F.asc("id")], limit=1), "id") == [(1,)]
    assert rows(db.delete("users"), "id") == [(2,)] and db.table("users").isEmpty()


def test_foreign_keys(db):
    db.create_table(Table("posts", (ColumnDef("pid", "INTEGER"), ColumnDef("uid", "INTEGER")), foreign_keys=(ForeignKey(("uid",), "users", ("id",), on_delete="cascade"),)))
    db.insert("posts", [(1, 77)])
    assert rows(db.pragma("foreign_key_check")) == [("posts", 1, "users", 0)]
    db.delete("posts")
    db.pragma("foreign_keys", "on")
    with pytest.raises(ConstraintError):
        db.insert("posts", [(1, 77)])
    db.insert("posts", [(1, 1), (2, 2), (3, None)])
    db.delete("users", F.col("id") == 1)
    assert rows(db.table("posts"), "pid") == [(2,), (3,)]
    assert rows(db.pragma("foreign_key_list", "posts"), "table", "from", "to") == [("users", "uid", "id")]


def test_transactions(db):
    db.begin()
    db.delete("users", F.col("id") == 1)
    db.savepoint("a")
    db.delete("users")
    db.rollback_to("a")
    assert rows(db.table("users"), "id") == [(2,)]
    db.release("a")
    with pytest.raises(KeyError):
        db.rollback_to("a")
    db.rollback()
    assert rows(db.table("users"), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        db.commit()
    db.begin()
    with pytest.raises(ConstraintError):
        db.insert("users", [(1, "x", 1)], conflict="rollback")
    with pytest.raises(ValueError):
        db.rollback()


def test_triggers(db):
    db.create_table(Table("log", (ColumnDef("what", "TEXT"), ColumnDef("id", "INTEGER"))))
    db.create_trigger(Trigger("t", "users", "after", "update", lambda d, r: d.insert("log", r.select(F.lit("aged").alias("what"), "id")) and None, when="age > 50", of=("age",)))
    db.update("users", {"age": 60}, F.col("id") == 1)
    db.update("users", {"age": 40}, F.col("id") == 2)
    assert rows(db.table("log")) == [("aged", 1)]

    def refuse(d, r):
        raise ConstraintError("no")

    db.create_trigger(Trigger("r", "users", "before", "delete", refuse))
    with pytest.raises(ConstraintError):
        db.delete("users")
    db.drop("trigger", "r")
    db.delete("users")


def test_ddl(db, spark):
    db.create_index(Index("by_age", "users", ("age",)), layout=True)
    assert rows(db.indexed_by("users", "by_age"), "id") == rows(db.not_indexed("users"), "id")
    with pytest.raises(KeyError):
        db.indexed_by("users", "nope")
    db.insert("users", [(3, "cid", 30)])
    with pytest.raises(ConstraintError):
        db.create_index(Index("u", "users", ("age",), unique=True))
    db.create_index(Index("p", "users", ("age",), unique=True, where="age < 25"))
    db.add_column("users", ColumnDef("note", "TEXT", default="'-'"))
    db.rename_column("users", "note", "remark")
    db.drop_column("users", "remark")
    with pytest.raises(ValueError):
        db.drop_column("users", "name")
    db.create_view("old", db.table("users").where("age > 25").select("id"), ["who"])
    assert rows(db.table("old")) == [(1,), (3,)] and rows(db.query("SELECT who FROM old WHERE who > 1")) == [(3,)]
    db.create_table_as("copy", db.table("users"))
    db.rename_table("copy", "copy2")
    assert db.table("copy2").count() == 3
    db.drop("table", "copy2")
    db.drop("table", "copy2", if_exists=True)
    with pytest.raises(KeyError):
        db.drop("view", "nothing")
    with pytest.raises(ValueError):
        db.create_table(Table("users", ()))
    with pytest.raises(ValueError):
        db.create_table(Table("s", (ColumnDef("a", "VARCHAR"),), strict=True))


def test_pragmas(db):
    assert rows(db.pragma("table_info", "users"), "name", "pk", "notnull") == [("age", 0, 0), ("id", 1, 0), ("name", 0, 1)]
    assert db.pragma("table_xinfo", "users").count() == 4
    assert rows(db.pragma("user_version", 5)) == [(5,)] and rows(db.pragma("page_count", 5)) == [(0,)]
    assert rows(db.pragma("integrity_check")) == [("ok",)]
    names = [r.name for r in db.pragma("pragma_list").collect()]
    assert len(names) == 63
    db.create_index(Index("i", "users", ("age",)))
    for name in names:
        arg = "i" if name in ("index_info", "index_xinfo") else "users" if name in ("index_list", "table_info", "table_xinfo", "foreign_key_list") else None
        assert db.pragma(name, arg).columns
    db.pragma("query_only", "on")
    with pytest.raises(ValueError):
        db.delete("users")
    assert "CREATE TABLE users" in db.ddl("users") and db.explain(db.table("users")).count() > 0


def test_save_and_open(db, spark, tmp_path):
    db.create_index(Index("i", "users", ("age",)))
    path = f"file://{tmp_path}/db"
    assert db.save(path) == 1
    db.delete("users", F.col("id") == 1)
    assert db.save(path) == 2
    assert rows(Database.open(spark, path).table("users"), "id") == [(2,)]
    old = Database.open(spark, path, 1)
    assert rows(old.table("users"), "id") == [(1,), (2,)] and old.state.tables["users"] == db.state.tables["users"] and old.state.indexes == db.state.indexes
    with pytest.raises(ConstraintError):
        old.insert("users", [(1, "again", 1)])


def test_sqlite_files(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, score REAL, raw BLOB)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i * 3, f"n{i}", i / 2, bytes([i])) for i in range(100)] + [(1000, None, None, None)])
        c.execute("CREATE TABLE k (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
        c.execute("INSERT INTO k VALUES ('x', 1)")
    spark.dataSource.register(SqliteSource)
    read = lambda t: spark.read.format("sqlite_file").option("path", path).option("table", t).load()
    df = read("t")
    assert df.count() == 101 and df.agg(F.sum("id"), F.sum("score")).first()[:] == (14850 + 1000, 2475.0)
    assert rows(read("k")) == [("x", 1)]
    assert write_table(df.where("id < 30"), path, "copy") == 10 and read("copy").count() == 10


def test_relational_edges(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    empty = spark.createDataFrame([], "y long")
    assert rel.not_in(left, "x", empty, "y").count() == 3
    assert rel.not_in(left, "x", spark.createDataFrame([(1,)], "y long"), "y").collect()[0].x == 2
    assert rel.not_in(left, "x", spark.createDataFrame([(1,), (None,)], "y long"), "y").count() == 0
    with pytest.raises(ValueError):
        rel.values(spark, [(1,), (1, 2)])
    with pytest.raises(ValueError):
        rel.compound(left, ("union", left.selectExpr("x", "x AS z")))
    with pytest.raises(ValueError):
        rel.limit(left, 1.5)
    assert rel.limit(left, 2.0).count() == 2 and rel.natural_join(left, empty).columns == ["x", "y"]


def test_streaming_windows(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    batch.write.parquet(f"file://{tmp_path}/in")
    events = stream.read_stream(spark, f"file://{tmp_path}/in", batch.schema)
    out = stream.windowed(events, "ts", "1 hour", "1 day", ["event_type"])
    q = out.writeStream.outputMode("complete").format("memory").queryName("stream_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_out").agg(F.sum("n")).first()[0] == batch.count()
    assert stream.sessions(batch, "ts", "5 minutes", "1 hour", "user_id").agg(F.sum("n")).first()[0] == batch.count()


def test_row_ids_of_more_rows_than_the_bounds_are_sampled_from(spark):
    rows = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_000).alias("k")).withColumn("x", F.when(F.col("k") % 3 > 0, F.col("k")))
    up = rel.with_rowid(rows, [rel.order_key(F.col("x")), "k"], "a")
    got = rel.with_rowid(up, [rel.order_key(F.col("x"), True), rel.order_key(F.col("k"), True)], "d").orderBy("a").collect()
    assert [r.k for r in got] == [k for k in range(20_000) if k % 3 == 0] + [k for k in range(20_000) if k % 3]
    assert [r.a for r in got] == list(range(1, 20_001))
    assert [r.d for r in got] == list(range(20_000, 0, -1))


def test_sqlite_files_of_the_driver_are_sent_to_executors(spark, tmp_path):
    path = f"{tmp_path}/y.db"
    write_table(spark.range(100).selectExpr("id", "'n' || id AS name"), path, "t")
    sent = ship_file(spark, path)
    os.remove(path)
    want = [(k, f"n{k}") for k in range(100)]
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_file").options(path=sent, shipped="true", table="t", partitions="3").load()
    assert sorted(tuple(r) for r in df.collect()) == want
    elsewhere = SqliteReader(f"/nowhere/{os.path.basename(sent)}", "t", ["bigint", "string"], 3, True)  # as on a machine without the driver's folders
    parts = spark.sparkContext.parallelize([Range(k, k + 50) for k in (1, 51)], 2)
    assert sorted(parts.flatMap(lambda r: list(elsewhere.read(r))).collect()) == want


def test_sqlite_files_with_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/z.db"
    assert write_table(spark.range(0), path, "t") <= 0
    spark.dataSource.register(SqliteSource)
    assert spark.read.format("sqlite_file").options(path=path, table="t").load().collect() == []
