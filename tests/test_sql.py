"""The SQL front end: statements in the dialect on a Database."""

import pytest

from ferrule.database import ConstraintError, Database
from ferrule.sql.lexer import lex


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.execute("""
        CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE COLLATE NOCASE, age INT DEFAULT 18 CHECK (age >= 0), twice INT GENERATED ALWAYS AS (age * 2) STORED);
        CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users(id) ON DELETE CASCADE, amount REAL);
        INSERT INTO users (id, name, age) VALUES (1, 'ann', 30), (2, 'bob', 20), (3, 'cid', NULL);
        INSERT INTO orders VALUES (1, 1, 5.5), (2, 1, 4.5), (3, 2, 1);
    """)
    return d


def q(db, sql):
    return [tuple(r) for r in db.query(sql).collect()]


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT 7 / 2, 7 / 2.0, 7 % 0, -7 / 2, 1 = 1, 'a' || 1 || NULL, 0x1F, 1_000", [(3, 3.5, None, -3, True, None, 31, 1000)]),
        ("SELECT name, age / 7 AS w FROM users WHERE w > 2 ORDER BY name DESC", [("ann", 4)]),
        ("SELECT name FROM users WHERE age IS NULL OR name LIKE 'A%' ORDER BY 1", [("ann",), ("cid",)]),
        ("SELECT name FROM users WHERE name GLOB '[a-b]*' AND NOT age < 25", [("ann",)]),
        ("SELECT user_id, count(*) AS n, sum(amount), total(amount), group_concat(id) FROM orders GROUP BY user_id HAVING n > 1", [(1, 2, 10.0, 10.0, "1,2")]),
        ("SELECT name, max(age) FROM users", [("ann", 30)]),
        ("SELECT u.name, o.amount FROM users u LEFT JOIN orders AS o ON o.user_id = u.id AND o.amount > 5 ORDER BY u.id", [("ann", 5.5), ("bob", None), ("cid", None)]),
        ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders) AND EXISTS (SELECT 1 FROM orders WHERE user_id = users.id AND amount < 2)", [("bob",)]),
        ("SELECT name, (SELECT max(amount) FROM orders o WHERE o.user_id = users.id) AS top FROM users ORDER BY id LIMIT 2", [("ann", 5.5), ("bob", 1.0)]),
        ("WITH t(k, v) AS (VALUES (1, 'x'), (2, 'y')), w AS (SELECT k FROM t) SELECT k FROM w UNION SELECT 9 EXCEPT SELECT 2 ORDER BY 1", [(1,), (9,)]),
        ("SELECT row_number() OVER (PARTITION BY user_id ORDER BY amount DESC) AS r, sum(amount) OVER w FROM orders WINDOW w AS (PARTITION BY user_id) ORDER BY id", [(1, 10.0), (2, 10.0), (1, 1.0)]),
        ("SELECT CASE age WHEN 30 THEN 'x' ELSE 'y' END, iif(age > 25, 1, 0), coalesce(age, -1), CAST('12abc' AS INTEGER) FROM users ORDER BY id", [("x", 1, 30, 12), ("y", 0, 20, 12), ("y", 0, -1, 12)]),
        ("SELECT date('2024-01-31', '+1 month'), strftime('%Y/%m', '2024-03-05'), unixepoch('1970-01-02')", [("2024-03-02", "2024/03", 86400)]),
        ("SELECT json_extract('{\"a\":[1,2]}', '$.a[#-1]'), '{\"a\":5}' ->> 'a', json_object('k', 1, 'v', 'x'), json_valid('{'), json_array_length('[1,2]')", [("2", "5", '{"k":1,"v":"x"}', 0, 2)]),
        ("SELECT printf('%05.1f|%q', 2.25, 'it''s'), upper('é'), instr('abc', 'c'), substr('hello', -3, 2), hex('a'), quote('x''y'), typeof(1), min(3, 1, NULL)", [("002.2|it''s", "é", 3, "ll", "61", "'x''y'", "integer", None)]),
        ("SELECT DISTINCT age IS NULL FROM users ORDER BY 1", [(False,), (True,)]),
        ("SELECT * FROM (VALUES (1, 2)) NATURAL JOIN (SELECT 1 AS column1, 3 AS z)", [(1, 2, 3)]),
        ("SELECT name FROM pragma_table_info('users') WHERE pk = 1", [("id",)]),
        ("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name", [("orders",), ("users",)]),
        ("SELECT name COLLATE NOCASE AS n FROM users WHERE name = 'ANN' COLLATE NOCASE OR upper(name) = 'BOB' ORDER BY n", [("ann",), ("bob",)]),
        ("SELECT id FROM orders ORDER BY amount LIMIT 1, 2", [(2,), (1,)]),
        ("SELECT id FROM orders ORDER BY id LIMIT -1 OFFSET 2", [(3,)]),
        ("VALUES (1, 'a'), (2, NULL)", [(1, "a"), (2, None)]),
        ("SELECT count(*) FILTER (WHERE amount > 2), avg(DISTINCT user_id) FROM orders", [(2, 1.5)]),
        ("SELECT 5 IS NOT 6, NULL IS NULL, (1, 2) < (1, 3), 3 BETWEEN 1 AND 2, 1 IN (), 2 NOT IN (1, NULL), 6 & 3, 1 << 2, ~0", [(True, True, True, False, False, None, 2, 4, -1)]),
    ],
)
def test_queries(db, sql, want):
    assert q(db, sql) == want


def test_session_functions_and_pattern_calls(db):
    assert q(db, "SELECT changes(), total_changes(), last_insert_rowid(), glob('a*', 'abc'), regexp('^b', 'abc'), like('a!%', 'A%', '!')") == [(3, 6, 3, True, False, True)]


def test_changes(db):
    assert q(db, "INSERT INTO users (name) VALUES ('dan') RETURNING id, age, twice") == [(4, 18, 36)]
    assert q(db, "UPDATE users SET age = age + 1 WHERE id = 1 RETURNING age") == [(31,)]
    db.execute("INSERT INTO users (id, name, age) VALUES (1, 'x', 5) ON CONFLICT (id) DO UPDATE SET age = users.age + excluded.age WHERE excluded.age > 1")
    assert q(db, "SELECT name, age, twice FROM users WHERE id = 1")[0][:2] == ("ann", 36)
    db.execute("INSERT OR IGNORE INTO users (id, name) VALUES (2, 'zed'); REPLACE INTO users (id, name) VALUES (2, 'zed')")
    assert q(db, "SELECT name FROM users WHERE id = 2") == [("zed",)]
    db.execute("UPDATE users SET age = amount * 10 FROM orders o WHERE o.user_id = users.id AND o.id = 2")
    assert q(db, "SELECT age FROM users WHERE id = 1") == [(45,)]
    db.execute("UPDATE users SET (age, name) = (1, 'low') WHERE id > 1 ORDER BY id LIMIT 1")
    assert q(db, "SELECT id, age FROM users WHERE name = 'low'") == [(2, 1)]
    assert q(db, "DELETE FROM users WHERE id IN (SELECT user_id FROM orders WHERE amount < 2) RETURNING name") == [("low",)]
    db.execute("DELETE FROM orders ORDER BY amount DESC LIMIT 1")
    assert q(db, "SELECT id FROM orders ORDER BY id") == [(2,), (3,)]
    db.execute("INSERT INTO orders (amount) SELECT amount * 2 FROM orders WHERE id = 2")
    assert q(db, "SELECT id, user_id, amount FROM orders WHERE user_id IS NULL") == [(4, None, 9.0)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO users (name, age) VALUES ('neg', -1)")


def test_schema_and_transactions(db):
    db.execute("CREATE VIEW old(n) AS SELECT name FROM users WHERE age > 25; CREATE UNIQUE INDEX i ON users (age DESC) WHERE age > 0; CREATE TABLE copy AS SELECT id, name FROM users")
    assert q(db, "SELECT n FROM old") == [("ann",)]
    db.execute("ALTER TABLE copy ADD COLUMN note TEXT DEFAULT 'n'; ALTER TABLE copy RENAME COLUMN note TO remark; ALTER TABLE copy RENAME TO copy2")
    assert q(db, "SELECT remark FROM copy2 INDEXED BY nothing WHERE id = 1") == [("n",)]
    db.execute("ALTER TABLE copy2 DROP COLUMN remark; DROP VIEW old; DROP VIEW IF EXISTS old; DROP INDEX i")
    db.execute("BEGIN IMMEDIATE; DELETE FROM copy2; SAVEPOINT s; INSERT INTO copy2 VALUES (9, 'z'); ROLLBACK TO s; RELEASE s; COMMIT")
    assert q(db, "SELECT count(*) FROM copy2") == [(0,)]
    db.execute("PRAGMA foreign_keys = ON; DELETE FROM users WHERE id = 1; ANALYZE; VACUUM")
    assert q(db, "SELECT id FROM orders") == [(3,)]
    assert q(db, "PRAGMA foreign_keys") == [(1,)] and len(q(db, "EXPLAIN QUERY PLAN SELECT * FROM users")) > 0
    db.execute("CREATE TABLE m (a INT, b INT, PRIMARY KEY (a, b), CONSTRAINT c CHECK (a < b)) WITHOUT ROWID; INSERT INTO m VALUES (1, 2)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO m VALUES (3, 2)")


@pytest.mark.parametrize("sql", ["SELECT FROM users", "SELECT nope FROM users", "SELECT * FROM nowhere", "SELECT 1 UNION SELECT 1, 2", "SELECT match('a', 'b')", "SELECT * FROM users JOIN orders", "VALUES (1), (1, 2)", "SELECT nofunc(1)", "FOO", "SELECT 1 LIMIT 1.5"])
def test_errors(db, sql):
    with pytest.raises(Exception):  # noqa: B017
        db.query(sql).collect()


def test_lexer():
    kinds = [(t.kind, t.text) for t in lex("a.\"b\"\"c\" [d] `e` 'f''g' x'4A' 1_0 .5e3 -- c\n/* d */ <> ->>")]
    assert kinds == [("name", "a"), ("op", "."), ("quoted", 'b"c'), ("quoted", "d"), ("quoted", "e"), ("string", "f'g"), ("blob", "4A"), ("number", "10"), ("number", ".5e3"), ("op", "<>"), ("op", "->>"), ("end", "")]
    with pytest.raises(SyntaxError):
        lex("a ? b")


def test_repl(db):
    import io

    from ferrule import repl

    out = io.StringIO()
    text = """.help
.tables
.schema orders
SELECT id,
  name FROM users WHERE id < 3
  ORDER BY id;
CREATE TRIGGER g AFTER DELETE ON orders BEGIN
  DELETE FROM users WHERE id = OLD.user_id;
END;
DELETE FROM orders WHERE id = 3;
SELECT count(*) AS n, max(age > 5) AS b FROM users;
SELECT nope FROM users;
.nothing
.exit
SELECT 1;
"""
    repl.loop(db, io.StringIO(text), out)
    got = out.getvalue()
    assert "orders\nusers\n" in got and "FOREIGN KEY (user_id) REFERENCES users (id) ON DELETE CASCADE" in got
    assert "id | name\n1 | ann\n2 | bob\nok\nok\nn | b\n2 | true\nerror: 'no such column: nope'\nunknown command: .nothing\n" in got
    assert repl.complete("SELECT ';';") and not repl.complete("SELECT ';'") and not repl.complete("CREATE TRIGGER x AFTER DELETE ON t BEGIN DELETE FROM t;")


def test_triggers_can_stop_a_statement(db):
    db.execute("CREATE TRIGGER stop BEFORE UPDATE OF age ON users WHEN NEW.age > 100 BEGIN SELECT RAISE(ABORT, 'too old'); END")
    with pytest.raises(ConstraintError, match="too old"):
        db.execute("UPDATE users SET age = age * 10 WHERE id = 1")
    db.execute("UPDATE users SET age = 99 WHERE id = 1; UPDATE users SET name = 'cy' WHERE id = 3; DROP TRIGGER stop; UPDATE users SET age = 101 WHERE id = 1")
    assert q(db, "SELECT age, name FROM users WHERE id <> 2 ORDER BY id") == [(101, "ann"), (None, "cy")]


NOT_IN = "CREATE TABLE a (id INTEGER PRIMARY KEY, x INTEGER, g INTEGER); INSERT INTO a VALUES (1, 1, 1), (2, 2, 1), (3, NULL, 2), (4, 4, 2), (5, 5, 2); CREATE TABLE b (y INTEGER, k INTEGER); INSERT INTO b VALUES (1, 1), (5, 1), (NULL, 2), (5, 3)"


@pytest.mark.parametrize(("where", "want"), [("k <> 2", [2, 4]), ("true", [2]), ("k > 3", [1, 2, 3, 4, 5])])
def test_not_in_beside_an_or_joins_by_equality(spark, where, want):
    db = Database(spark)
    db.execute(NOT_IN)
    for text in (f"id = 2 OR x NOT IN (SELECT y FROM b WHERE {where})", f"id = 2 OR NOT (x IN (SELECT y FROM b WHERE {where}))"):
        found = db.query(f"SELECT id FROM a WHERE {text}")
        assert sorted(r.id for r in found.collect()) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_not_in_is_null_where_unknown(spark):
    db = Database(spark)
    db.execute(NOT_IN)
    given = lambda sql: [r.n for r in db.query(sql).orderBy("id").collect()]
    assert given("SELECT id, x NOT IN (SELECT y FROM b) AS n FROM a") == [False, None, None, None, False]
    assert given("SELECT id, x NOT IN (SELECT y FROM b WHERE k <> 2) AS n FROM a") == [False, True, None, True, False]
    assert sorted(r.id for r in db.query("SELECT id FROM a WHERE id = 2 OR x NOT IN (SELECT y FROM b WHERE b.k = a.g)").collect()) == [2]
