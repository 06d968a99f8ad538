"""Statements that change data and schema, as scripts in the dialect's SQL; every oracle states the rows that must result."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ferrule.database import FLAGS, KNOBS, NOOPS, SCHEMA_PRAGMAS, Database
from ferrule.operators import dml
from ferrule.plans.dialect import database
from ferrule.plans.registry import Registry
from ferrule.session import staging_root

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_T = "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, n INTEGER DEFAULT 7); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2), (3, NULL, 3); "
_ALL = "; SELECT id, name, n FROM t"


def rows(columns: str, *values: str) -> str:
    """An oracle: the rows of a table of constants."""
    return f"SELECT * FROM (VALUES {', '.join(f'({v})' for v in values)}) v({columns})"


def script(name: str, sql: str, oracle: str) -> None:
    R.add(name, oracle)(lambda t: database(t, sql).query(sql))


def change(name: str, sql: str, *left: str) -> None:
    """A change of the table t and all its rows afterwards."""
    script(name, _T + sql + _ALL, rows("id, name, n", *left))


def returning(name: str, sql: str, *given: str, columns: str = "id, name, n") -> None:
    """A change of t and the rows that RETURNING gives."""
    script(name, _T + sql, rows(columns, *given))


# Plan variants of INSERT -----------------------------------------------------------------------------------------

A, B, C = "1, 'a', 1", "2, 'b', 2", "3, NULL, 3"
_UP = "ON CONFLICT (id) DO UPDATE SET n = t.n * 10 + excluded.n"
change("plan_insert", "INSERT INTO t (id, name) VALUES (9, 'z')", A, B, C, "9, 'z', 7")
returning("plan_insert_returning", "INSERT INTO t (name) VALUES ('z') RETURNING id, name, n", "4, 'z', 7")
change("plan_insert_upsert", f"INSERT INTO t VALUES (1, 'z', 5) {_UP}", "1, 'a', 15", B, C)
returning("plan_insert_upsert_returning", f"INSERT INTO t VALUES (1, 'z', 5) {_UP} RETURNING *", "1, 'a', 15")
change("plan_insert_many", "INSERT INTO t VALUES (8, 'y', 1), (9, 'z', 2)", A, B, C, "8, 'y', 1", "9, 'z', 2")
returning("plan_insert_many_returning", "INSERT INTO t (name) VALUES ('y'), ('z') RETURNING id, name", "4, 'y'", "5, 'z'", columns="id, name")
change("plan_insert_many_upsert", f"INSERT INTO t VALUES (1, 'z', 5), (1, 'z', 6), (9, 'q', 1), (9, 'r', 2) {_UP}", "1, 'a', 156", B, C, "9, 'q', 12")
returning("plan_insert_many_upsert_returning", f"INSERT INTO t VALUES (1, 'z', 5), (8, 'n', 1) {_UP} RETURNING id, n", "1, 15", "8, 1", columns="id, n")
change("plan_insert_do_nothing", "INSERT INTO t VALUES (1, 'z', 5) ON CONFLICT DO NOTHING", A, B, C)
script("plan_insert_do_nothing_returning", _T + "INSERT INTO t VALUES (9, 'z', 5) ON CONFLICT (id) DO NOTHING RETURNING id", rows("id", "9"))
change("plan_insert_many_do_nothing", "INSERT INTO t VALUES (1, 'z', 5), (9, 'first', 1), (9, 'second', 2) ON CONFLICT DO NOTHING", A, B, C, "9, 'first', 1")
script("plan_insert_many_do_nothing_returning", _T + "INSERT INTO t VALUES (1, 'z', 5), (9, 'y', 6) ON CONFLICT (id) DO NOTHING RETURNING id, name", rows("id, name", "9, 'y'"))
change("plan_insert_expression", "INSERT INTO t VALUES (4 + 5, upper('z') || 1, length('abc') * 2)", A, B, C, "9, 'Z1', 6")
returning("plan_insert_expression_returning", "INSERT INTO t VALUES (4 + 5, 'z' || 1, 2 * 3) RETURNING id + 1 AS id, name || '!' AS name, n", "10, 'z1!', 6")
change("plan_insert_expression_upsert", f"INSERT INTO t VALUES (3 - 2, 'z', 2 + 3) {_UP}", "1, 'a', 15", B, C)
returning("plan_insert_expression_upsert_returning", f"INSERT INTO t VALUES (3 - 2, 'z', 2 + 3) {_UP} RETURNING n", "15", columns="n")
change("plan_insert_many_expression", "INSERT INTO t VALUES (4 + 4, 'y', 1), (9, 'z' || 'z', 1 + 1)", A, B, C, "8, 'y', 1", "9, 'zz', 2")
returning("plan_insert_many_expression_returning", "INSERT INTO t VALUES (4 + 4, 'y', 1), (9, 'z' || 'z', 1 + 1) RETURNING id", "8", "9", columns="id")
change("plan_insert_many_expression_upsert", f"INSERT INTO t VALUES (2 - 1, 'y', 1 + 1), (9, 'z', 1) {_UP}", "1, 'a', 12", B, C, "9, 'z', 1")
returning("plan_insert_many_expression_upsert_returning", f"INSERT INTO t VALUES (2 - 1, 'y', 1 + 1), (9, 'z', 1) {_UP} RETURNING id, n", "1, 12", "9, 1", columns="id, n")
change("plan_insert_expression_do_nothing", "INSERT INTO t VALUES (2 - 1, 'y', 1 + 1) ON CONFLICT DO NOTHING", A, B, C)
returning("plan_insert_expression_do_nothing_returning", "INSERT INTO t VALUES (8 + 1, 'y', 1 + 1) ON CONFLICT (id) DO NOTHING RETURNING id", "9", columns="id")
change("plan_insert_many_expression_do_nothing", "INSERT INTO t VALUES (2 - 1, 'y', 1), (8 + 1, 'z', 2) ON CONFLICT DO NOTHING", A, B, C, "9, 'z', 2")
returning("plan_insert_many_expression_do_nothing_returning", "INSERT INTO t VALUES (2 - 1, 'y', 1), (8 + 1, 'z', 2) ON CONFLICT (id) DO NOTHING RETURNING id", "9", columns="id")
change("plan_insert_select", "INSERT INTO t SELECT id + 10, name, n FROM t WHERE n < 3", A, B, C, "11, 'a', 1", "12, 'b', 2")
returning("plan_insert_select_returning", "INSERT INTO t SELECT id + 10, name, n FROM t WHERE n < 2 RETURNING id, name", "11, 'a'", columns="id, name")
change("plan_insert_select_upsert", f"INSERT INTO t SELECT id, name, 5 FROM t WHERE n < 3 {_UP}", "1, 'a', 15", "2, 'b', 25", C)
returning("plan_insert_select_upsert_returning", f"INSERT INTO t SELECT id, name, 5 FROM t WHERE n = 2 {_UP} RETURNING n", "25", columns="n")
change("plan_insert_select_do_nothing", "INSERT INTO t SELECT id * 3, 'new', n FROM t ON CONFLICT DO NOTHING", A, B, C, "6, 'new', 2", "9, 'new', 3")
returning("plan_insert_select_do_nothing_returning", "INSERT INTO t SELECT id * 3, 'new', n FROM t ON CONFLICT (id) DO NOTHING RETURNING id", "6", "9", columns="id")
change("plan_insert_default_values", "INSERT INTO t DEFAULT VALUES", A, B, C, "4, NULL, 7")

# The same with repeated and NULL keys, without keys, and with foreign keys ---------------------------------------

_K = "CREATE TABLE k (a INTEGER, v TEXT, UNIQUE (a)); INSERT INTO k VALUES (1, 'old'), (NULL, 'none'); "
_KALL = "; SELECT a, v FROM k"
script("dml_do_nothing_repeated", _K + "INSERT INTO k VALUES (1, 'x'), (2, 'b'), (2, 'a'), (NULL, 'n'), (NULL, 'm') ON CONFLICT (a) DO NOTHING" + _KALL, rows("a, v", "1, 'old'", "NULL, 'none'", "2, 'b'", "NULL, 'n'", "NULL, 'm'"))
script("dml_replace_repeated", _K + "INSERT OR REPLACE INTO k VALUES (1, 'x'), (2, 'b'), (2, 'a'), (NULL, 'n')" + _KALL, rows("a, v", "1, 'x'", "NULL, 'none'", "2, 'a'", "NULL, 'n'"))
script("dml_upsert_repeated", _K + "INSERT INTO k VALUES (1, 'x'), (1, 'y'), (2, 'b'), (2, 'a'), (NULL, 'n') ON CONFLICT (a) DO UPDATE SET v = k.v || excluded.v" + _KALL, rows("a, v", "1, 'oldxy'", "NULL, 'none'", "2, 'ba'", "NULL, 'n'"))
_BAG = "CREATE TABLE bag (a INTEGER, b TEXT); INSERT INTO bag VALUES (1, 'x'), (1, 'x'), (NULL, NULL), (2, NULL), (2, NULL); "
script("dml_delete_limited_no_key", _BAG + "DELETE FROM bag WHERE a = 1 LIMIT 1; DELETE FROM bag ORDER BY a LIMIT 1; SELECT * FROM bag", rows("a, b", "1, 'x'", "2, NULL", "2, NULL"))
script("dml_update_limited_no_key", _BAG + "UPDATE bag SET b = 'new' WHERE b IS NULL ORDER BY a DESC LIMIT 1; SELECT * FROM bag", rows("a, b", "1, 'x'", "1, 'x'", "NULL, NULL", "2, 'new'", "2, NULL"))
_FK = "PRAGMA foreign_keys = ON; CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (k INTEGER, p INTEGER DEFAULT 3 REFERENCES p (id) ON DELETE {} ON UPDATE {}); INSERT INTO p VALUES (1), (2), (3); INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL), (4, 1); "
for _act, _del, _upd in (("cascade", ("2, 2", "3, NULL"), ("1, 11", "2, 2", "3, NULL", "4, 11")), ("set null", ("1, NULL", "2, 2", "3, NULL", "4, NULL"), ("1, NULL", "2, 2", "3, NULL", "4, NULL")), ("set default", ("1, 3", "2, 2", "3, NULL", "4, 3"), ("1, 3", "2, 2", "3, NULL", "4, 3"))):
    _n = _act.replace(" ", "_")
    script(f"constraint_fk_on_delete_{_n}", _FK.format(_act, "RESTRICT") + "DELETE FROM p WHERE id = 1; SELECT k, p FROM c", rows("k, p", *_del))
    script(f"constraint_fk_on_update_{_n}", _FK.format("RESTRICT", _act) + "UPDATE p SET id = 11 WHERE id = 1; SELECT k, p FROM c", rows("k, p", *_upd))
script("dml_delete_plan", _T + "DELETE FROM t WHERE n > 1" + _ALL, rows("id, name, n", A))
script("dml_delete_returning_limited", _T + "DELETE FROM t WHERE n > 1 RETURNING id, n ORDER BY n DESC LIMIT 1", rows("id, n", "3, 3"))
script("dml_update_returning_limited", _T + "UPDATE t SET n = n + 100 RETURNING id, n ORDER BY id DESC LIMIT 2", rows("id, n", "2, 102", "3, 103"))
script("dml_update_from_sql", _T + "CREATE TABLE s (k INTEGER, w INTEGER); INSERT INTO s VALUES (1, 50), (3, 70); UPDATE t SET n = w FROM s WHERE s.k = t.id" + _ALL, rows("id, name, n", "1, 'a', 50", B, "3, NULL, 70"))
script("dml_with_before", _T + "WITH w(x) AS (SELECT 2) DELETE FROM t WHERE id IN (SELECT x FROM w)" + _ALL, rows("id, name, n", A, C))
script("dml_session_counts", _T + "UPDATE t SET n = 0 WHERE id < 3; SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS r", rows("c, t, r", "2, 5, 3"))

# Schema ----------------------------------------------------------------------------------------------------------

script("ddl_create_view", "CREATE VIEW v (k, name) AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; SELECT k, name FROM v", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
script("ddl_create_as_sql", "CREATE TABLE s AS SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1; SELECT segment, n FROM s", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
script("ddl_alter_sql", _T + "ALTER TABLE t ADD COLUMN note TEXT DEFAULT 'x'; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t DROP COLUMN n; ALTER TABLE t RENAME TO u; SELECT * FROM u", rows("id, label, note", "1, 'a', 'x'", "2, 'b', 'x'", "3, NULL, 'x'"))
script("ddl_drop_all", _T + "CREATE VIEW v AS SELECT 1; CREATE INDEX i ON t (n); CREATE TABLE u (a INT); DROP VIEW v; DROP INDEX i; DROP TABLE u; DROP TABLE IF EXISTS u; SELECT type, name FROM sqlite_master", rows("type, name", "'table', 't'"))
script("ddl_generated_sql", "CREATE TABLE g (a INTEGER, b INTEGER GENERATED ALWAYS AS (a * 2) STORED, c TEXT DEFAULT 'd'); INSERT INTO g (a) VALUES (1), (NULL); UPDATE g SET a = 5 WHERE a = 1; SELECT * FROM g", rows("a, b, c", "5, 10, 'd'", "NULL, NULL, 'd'"))
script("ddl_indexed_scan", _T + "CREATE UNIQUE INDEX i ON t (name) WHERE n > 1; SELECT id FROM t INDEXED BY i WHERE name = 'b'", rows("id", "2"))
script("ddl_no_op", _T + "ANALYZE; REINDEX; VACUUM; CREATE TABLE IF NOT EXISTS t (x INT)" + _ALL, rows("id, name, n", A, B, C))
script("dml_savepoints", _T + "BEGIN; DELETE FROM t WHERE id = 1; SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; RELEASE s; COMMIT; BEGIN; DELETE FROM t; ROLLBACK" + _ALL, rows("id, name, n", B, C))
_LOG = "CREATE TABLE log (what TEXT, was INTEGER, now INTEGER); "
script("trigger_insert", _T + _LOG + "CREATE TRIGGER g AFTER INSERT ON t WHEN NEW.n > 5 BEGIN INSERT INTO log VALUES ('in', NULL, NEW.id); END; INSERT INTO t VALUES (8, 'x', 9), (9, 'y', 1); SELECT * FROM log", rows("what, was, now", "'in', NULL::BIGINT, 8"))
script("trigger_update", _T + _LOG + "CREATE TRIGGER g AFTER UPDATE OF n ON t FOR EACH ROW BEGIN INSERT INTO log VALUES ('up', OLD.n, NEW.n); UPDATE t SET name = 'seen' WHERE id = NEW.id; END; UPDATE t SET n = n + 10 WHERE id > 1; UPDATE t SET name = 'q' WHERE id = 1; SELECT what, was, now, name FROM log JOIN t ON n = now", rows("what, was, now, name", "'up', 2, 12, 'seen'", "'up', 3, 13, 'seen'"))
script("trigger_delete", _T + _LOG + "CREATE TRIGGER g BEFORE DELETE ON t BEGIN INSERT INTO log SELECT 'gone', OLD.id, n FROM t WHERE id = OLD.id; DELETE FROM log WHERE was = OLD.id + 100; END; DELETE FROM t WHERE id < 3; DROP TRIGGER g; SELECT what, was, now FROM log", rows("what, was, now", "'gone', 1, 1", "'gone', 2, 2"))

# CHECK forms -----------------------------------------------------------------------------------------------------

#: Form, CHECK text, and DuckDB's text where it differs.
_CHECKS = [
    ("compare", "p_size > 10", None), ("is_null", "p_name IS NOT NULL", None), ("glob", "p_brand GLOB 'Brand#[1-3]*'", None), ("regexp", "p_brand REGEXP '^Brand'", "p_brand LIKE 'Brand%'"), ("like", "p_name LIKE '%A%'", "lower(p_name) LIKE '%a%'"),
    ("in_list", "p_size IN (1, 2, 3, 4)", None), ("between", "p_size BETWEEN 5 AND 20", None), ("is_bool", "(p_size > 25) IS TRUE", "p_size > 25"), ("truthy", "p_size - 7", "p_size <> 7"), ("is_distinct", "p_size IS DISTINCT FROM 9", None),
    ("length_compare", "length(p_name) > 8", None), ("octet_length_compare", "octet_length(p_name) > 8", "octet_length(p_name::BLOB) > 8"), ("unicode_compare", "unicode(p_type) > 80", None), ("unicode_is_null", "unicode(p_type) IS NOT NULL", None), ("sign_compare", "sign(p_size - 10) >= 0", None),
    ("hex_compare", "hex(p_size) > '33'", "hex(p_size::VARCHAR) > '33'"), ("quote_compare", "quote(p_brand) <> '''x'''", "p_brand <> 'x'"), ("nullif_is_null", "nullif(p_size, 10) IS NOT NULL", None), ("replace_compare", "replace(p_brand, 'Brand', 'B') <> 'B#11'", None),
    ("replace_column_compare", "replace(p_name, p_brand, '') = p_name", None), ("round_compare", "round(p_retailprice, 0) > 1000", None), ("rounding_compare", "ceil(p_retailprice) > 1000 AND floor(p_retailprice) < 9000", None), ("cast_compare", "CAST(p_retailprice AS INTEGER) > 1000", "trunc(p_retailprice) > 1000"),
    ("min_max_column_compare", "max(p_size, 10) < 40", "greatest(p_size, 10) < 40"), ("concat_compare", "p_brand || p_type <> 'x'", None), ("concat_ws_compare", "concat_ws('-', p_brand, p_size) <> 'Brand#1-1'", None), ("json_valid_compare", "json_valid(p_name) = 0", "true"),
    ("abs_compare", "abs(p_size - 20) < 15", None), ("unary_math_compare", "sqrt(p_size) > 3", None), ("binary_math_compare", "power(p_size, 2) > 100", None), ("arithmetic_compare", "p_size + 5 > 20", None), ("multiply_compare", "p_size * 3 > 60", None),
    ("divide_compare", "p_size / 4 > 5", "p_size // 4 > 5"), ("modulo_compare", "p_size % 3 <> 0", None), ("type_of_compare", "typeof(p_size) = 'integer'", "true"), ("no_case_compare", "p_brand = 'brand#1' COLLATE NOCASE", "lower(p_brand) = 'brand#1'"), ("case_fold_compare", "upper(p_brand) <> 'BRAND#11'", None),
    ("trim_compare", "trim(p_name) = p_name", None), ("coalesce_compare", "coalesce(nullif(p_size, 3), 0) > 0", None), ("instr_compare", "instr(p_name, 'a') > 0", None), ("substr_compare", "substr(p_brand, 1, 5) = 'Brand'", None), ("and", "p_size > 3 AND p_size < 30", None), ("or", "p_size < 3 OR p_size > 30", None), ("not", "NOT p_size > 30", None),
]


@R.add("check_forms", " UNION ALL ".join(f"SELECT '{n}' AS form, count(*) FILTER (WHERE NOT ({o or c})) AS broken FROM part" for n, c, o in _CHECKS))
def _(t):
    part = t("part")
    db = Database(part.sparkSession)
    columns = "p_partkey BIGINT, p_name TEXT, p_brand TEXT, p_type TEXT, p_size INTEGER, p_retailprice REAL"
    db.execute(f"CREATE TABLE part ({columns}, {', '.join(f'CHECK ({c})' for _, c, _ in _CHECKS)})")
    checks = db.state.tables["part"].checks
    broken = part.agg(*(F.count(F.when(~F.coalesce(F.expr(c), F.lit(True)), 1)).alias(n) for (n, *_), c in zip(_CHECKS, checks)))
    return broken.select(F.explode(F.array(*(F.struct(F.lit(n).alias("form"), F.col(f"`{n}`").alias("broken")) for n, *_ in _CHECKS))).alias("r")).select("r.*")


@R.add("constraint_not_null", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 500")
def _(t):
    return dml.not_null_violations(t("supplier").withColumn("b", F.expr("nullif(s_acctbal >= 500, false)")), ["s_suppkey", "b"]).select("s_suppkey")


# Pragmas ---------------------------------------------------------------------------------------------------------

_SCHEMA = "CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x', twice INTEGER GENERATED ALWAYS AS (id * 2)); CREATE TABLE c (k INTEGER, p INTEGER REFERENCES p (id) ON DELETE CASCADE ON UPDATE SET NULL); CREATE UNIQUE INDEX ci ON c (k, p) WHERE k > 0; INSERT INTO c VALUES (1, 5), (2, NULL); "


def pragma(name: str, argument: str, columns: str, *values: str) -> None:
    script(f"pragma_{name}_rows", f"{_SCHEMA} PRAGMA {name}{argument}", rows(columns, *values))


_SETTINGS = {**FLAGS, **KNOBS}


@R.add("pragma_settings", rows("name, value", *(f"'{n}', '{9 if n in FLAGS else v}'" for n, v in _SETTINGS.items())))
def _(t):
    """Every flag and knob; flags are set first."""
    db = Database(t("region").sparkSession)
    db.execute("; ".join(f"PRAGMA {n} = 9" for n in FLAGS))
    out = None
    for n in _SETTINGS:
        one = db.query(f"PRAGMA {n}").select(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


@R.add("pragma_no_ops", rows("name, n", *(f"'{n}', 0" for n in NOOPS)))
def _(t):
    db = Database(t("region").sparkSession)
    out = None
    for n in NOOPS:
        one = db.query(f"PRAGMA {n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


pragma("database_list", "", "seq, name, file", "0, 'main', ''", "1, 'temp', ''")
pragma("collation_list", "", "seq, name", "0, 'RTRIM'", "1, 'NOCASE'", "2, 'BINARY'")
pragma("integrity_check", "", "integrity_check", "'ok'")
pragma("quick_check", "", "quick_check", "'ok'")
pragma("module_list", "", "name", *(f"'pragma_{n}'" for n in SCHEMA_PRAGMAS))
pragma("pragma_list", "", "name", *(f"'{n}'" for n in sorted((*FLAGS, *KNOBS, *NOOPS, *SCHEMA_PRAGMAS))))
pragma("table_list", "", "schema, name, type, ncol, wr, strict", "'main', 'p', 'table', 3, 0, 0", "'main', 'c', 'table', 2, 0, 0")
pragma("table_xinfo", "('p')", 'cid, name, type, "notnull", dflt_value, pk, hidden', "0, 'id', 'INTEGER', 0, NULL, 1, 0", "1, 'name', 'TEXT', 1, '''x''', 0, 0", "2, 'twice', 'INTEGER', 0, NULL, 0, 2")
pragma("index_list", "(c)", 'seq, name, "unique", origin, partial', "0, 'ci', 1, 'c', 1")
pragma("index_xinfo", "(ci)", 'seqno, cid, name, "desc", coll, key', "0, 0, 'k', 0, 'BINARY', 1", "1, 1, 'p', 0, 'BINARY', 1", "2, -1, NULL, 0, 'BINARY', 0")
pragma("foreign_key_list", "(c)", 'id, seq, "table", "from", "to", on_update, on_delete, match', "0, 0, 'p', 'p', 'id', 'SET NULL', 'CASCADE', 'NONE'")
pragma("foreign_key_check", "", '"table", rowid, parent, fkid', "'c', 1, 'p', 0")
pragma("stats", "", "tbl, idx, wdth, hght, flgs", "'p', NULL::VARCHAR, 3, 0, 0", "'c', NULL, 2, 0, 0")
script("pragma_functions", "SELECT count(*) > 80 AS many, sum(name IN ('abs', 'json_extract', 'printf', 'strftime')) AS known FROM pragma_function_list()", rows("many, known", "true, 4"))
script("pragma_compile_options_rows", "SELECT count(*) > 0 AS found FROM pragma_compile_options()", rows("found", "true"))


@R.add("explain_query_plan_shape", rows("filters, joins", "true, true"))
def _(t):
    sql = "EXPLAIN QUERY PLAN SELECT n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'"
    plan = database(t, sql).query(sql)
    return plan.agg(F.max(F.col("detail").contains("Filter")).alias("filters"), F.max(F.col("detail").contains("Join")).alias("joins"))


# Files -----------------------------------------------------------------------------------------------------------


@R.add("store_versions", "SELECT 1 AS version, n_nationkey::BIGINT AS k, n_name AS name FROM nation UNION ALL SELECT 2, n_nationkey, n_name || '!' FROM nation WHERE n_regionkey < 3")
def _(t):
    """A database saved twice; both versions are read back."""
    spark = t("region").sparkSession
    path, db = f"{staging_root(spark)}/store-{uuid.uuid4().hex}", database(t, "nation")
    db.execute("CREATE TABLE n AS SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name, n_regionkey AS r FROM nation")
    first = db.save(path)
    db.execute("DELETE FROM n WHERE r >= 3; UPDATE n SET name = name || '!'")
    second = db.save(path)
    read = lambda v: Database.open(spark, path, v).query(f"SELECT {v} AS version, k, name FROM n")
    return read(first).union(read(second))


@R.add("store_sqlite", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    """A table written to a SQLite 3 file and read back; the driver writes it, and the executors read copies sent to them."""
    from ferrule.sources.sqlite_file import SqliteSource, ship_file, write_table

    spark = t("region").sparkSession
    spark.dataSource.register(SqliteSource)
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "store.db")
        write_table(t("customer").select("c_custkey", "c_name", "c_acctbal"), path, "customer")
        sent = ship_file(spark, path)
    return spark.read.format("sqlite_file").options(path=sent, shipped="true", table="customer", partitions="4").load()
