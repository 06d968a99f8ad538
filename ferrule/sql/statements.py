"""Statements of the dialect on a Database: queries become Spark SQL, the rest calls of its methods."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.database import ColumnDef, ConstraintError, Database, ForeignKey, Index, Table, Trigger
from ferrule.operators import dml
from ferrule.sql import functions as fn
from ferrule.sql.lexer import Token
from ferrule.sql.select import Parser, Scope, kind, name


def run(db: Database, sql: str) -> DataFrame | None:
    """All statements of a text; each is planned after the one before it ran. The last one's rows, if it gives any."""
    if not getattr(db.spark, "_ferrule_sql", False):  # once for a session
        fn.register(db.spark)
        db.spark._ferrule_sql = True
    out, parser = None, None
    parser = Statements(db, sql)
    while parser.now.kind != "end":
        if parser.accept(";"):
            continue
        out = parser.statement()
        if parser.now.kind != "end":
            parser.expect(";")
    return out


class Statements(Parser):
    def __init__(self, db: Database, sql: str) -> None:
        super().__init__(sql, lambda t: db.table(t).dtypes, self._pragma_view, bool(db.settings["case_sensitive_like"]))
        self.db = db

    @property
    def session(self) -> dict:
        number = lambda n: ("NULL" if n is None else str(n), "int")
        return {"changes": number(self.db.changes), "total_changes": number(self.db.total_changes), "last_insert_rowid": number(self.db.last_insert_rowid)}

    def _pragma_view(self, function: str, argument: str | None) -> str:
        view = f"{function}_{uuid.uuid4().hex[:8]}"
        self.db.create_view(view, self.db.pragma(function, argument))
        return view

    def _name(self) -> str:
        n = self.identifier()
        return self.identifier() if self.accept(".") else n

    # Queries -----------------------------------------------------------------------------------------------------

    def _frame(self, query) -> DataFrame:
        self.db.register()
        for master in ("sqlite_master", "sqlite_schema", "sqlite_temp_master", "sqlite_temp_schema"):
            if master in self.sql.lower():
                self.db.table(master).createOrReplaceTempView(master)
        text, out = query(None)
        return self.db.spark.sql(text)

    def statement(self) -> DataFrame | None:
        w = self.now.word
        if w == "WITH" and self._after_with() in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
            return self._with()
        if w in ("SELECT", "VALUES") or w == "WITH":
            return self._frame(self.query())
        if self.accept("EXPLAIN", "QUERY", "PLAN"):
            return self.db.explain(self._frame(self.query()))
        handler = getattr(self, f"_{w.lower()}", None) if w in ("INSERT", "REPLACE", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "BEGIN", "COMMIT", "END", "ROLLBACK", "SAVEPOINT", "RELEASE", "PRAGMA", "ANALYZE", "REINDEX", "VACUUM") else None
        if handler is None:
            raise SyntaxError(f"near {self.now.text!r}: syntax error")
        self.take()
        return handler()

    def _after_with(self) -> str:
        """The word that begins the statement after its common table expressions."""
        depth, at = 0, self.i
        for t in self.tokens[at:]:
            depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind == "op" else 0
            if depth == 0 and t.word in ("SELECT", "VALUES", "INSERT", "REPLACE", "UPDATE", "DELETE"):
                return t.word
        return ""

    def _with(self) -> DataFrame | None:
        """WITH before a change: the expressions are views for as long as the statement runs."""
        self.expect("WITH")
        self.accept("RECURSIVE")
        before = self.db.state.views
        try:
            for c, columns, body in iter(self._cte, None):
                df = self._frame(body)
                self.db._set(views={**self.db.state.views, c.lower(): df.toDF(*columns) if columns else df})
                if not self.accept(","):
                    break
            return self.statement()
        finally:
            self.db._set(views=before)

    # Data changes ------------------------------------------------------------------------------------------------

    def _scope(self, table: str, alias: str | None = None) -> Scope:
        return Scope(self._typed(alias or table, [(c, kind(k)) for c, k in self.db.table(table).dtypes]), names={f"{(alias or table).lower()}.{c.lower()}": name(c) for c in self.db.table(table).columns})

    def _column(self, x, scope: Scope) -> Column:
        return F.expr(x(scope)[0])

    def _returning(self, touched: DataFrame, scope: Scope) -> DataFrame | None:
        if not self.accept("RETURNING"):
            return None
        items = self.listed(self._item)
        cells = []
        for x, alias, label in items:
            cells += [F.col(c) for c in touched.columns] if x is None else [self._column(x, scope).alias(alias or getattr(x, "column", None) or label)]
        return touched.select(*cells)

    def _policy(self) -> str:
        return self.take().word.lower() if self.accept("OR") else "abort"

    def _replace(self) -> DataFrame | None:
        return self._insert("replace")

    def _insert(self, policy: str | None = None) -> DataFrame | None:
        policy = policy or self._policy()
        self.expect("INTO")
        table = self._name()
        alias = self.identifier() if self.accept("AS") else None
        columns = None
        if self.accept("("):
            columns = self.listed(self.identifier)
            self.expect(")")
        rows: DataFrame | None = None
        if not self.accept("DEFAULT", "VALUES"):
            rows = self._frame(self.query())
            definition = self.db.state.tables[table.lower()]
            names = columns or [c.name for c in definition.columns if not c.generated]
            if len(rows.columns) != len(names):
                raise ValueError(f"table {table} has {len(names)} columns but {len(rows.columns)} values were supplied")
            rows = rows.toDF(*names)
        key, changes, where = None, None, None
        scope = self._scope(table, alias)
        if self.accept("ON", "CONFLICT"):
            key = []
            if self.accept("("):
                key = self.listed(self.identifier)
                self.expect(")")
            self.expect("DO")
            if not self.accept("NOTHING"):
                self.expect("UPDATE", "SET")
                for c in self.db.table(table).columns:
                    scope.types[f"excluded.{c.lower()}"] = scope.types[c.lower()]
                    scope.names[f"excluded.{c.lower()}"] = name(f"excluded_{c}")
                changes = self._assignments(scope)
                where = self._column(self.expr(), scope) if self.accept("WHERE") else None
            if not key:
                first = self.db._keys(self.db.state.tables[table.lower()])
                key = list(first[0][0]) if first else None
        touched = self.db.insert(table, rows, conflict=policy, on_conflict=key, set_=changes, where=where)
        return self._returning(touched, self._scope(table, alias))

    def _assignments(self, scope: Scope) -> dict[str, Column]:
        out: dict[str, Column] = {}

        def one() -> None:
            if self.accept("("):
                names = self.listed(self.identifier)
                self.expect(")", "=", "(")
                values = self.listed(self.expr)
                self.expect(")")
            else:
                names = [self.identifier()]
                self.expect("=")
                values = [self.expr()]
            for n, v in zip(names, values, strict=True):
                if n.lower() in (k.lower() for k in out):
                    raise ValueError(f"column {n} is set twice")
                out[n] = self._column(v, scope)

        self.listed(one)
        return out

    def _tail(self, scope: Scope) -> tuple[list[Column], int | None, int]:
        order = [self._order(scope) for _ in [0]] if self.accept("ORDER", "BY") else []
        while order and self.accept(","):
            order.append(self._order(scope))
        limit = self._limit() if self.now.word == "LIMIT" else ""
        words = limit.split()
        n = (-1 if words[1] == "ALL" else int(words[1])) if "LIMIT" in words else None
        return order, n, int(words[words.index("OFFSET") + 1]) if "OFFSET" in words else 0

    def _order(self, scope: Scope) -> Column:
        x = F.expr(self.expr()(scope)[0])
        return x.desc_nulls_last() if self.accept("DESC") else (x.asc_nulls_first(), self.accept("ASC"))[0]

    def _update(self) -> DataFrame | None:
        self._policy()
        table = self._name()
        alias = self.identifier() if self.accept("AS") else None
        self.expect("SET")
        scope, at = self._scope(table, alias), self.i
        # FROM comes after the assignments that speak of it: look ahead for it, then parse in order.
        depth = 0
        while self.now.kind != "end" and self.now.text != ";" and not (depth == 0 and self.now.word in ("FROM", "WHERE", "RETURNING", "ORDER", "LIMIT")):
            depth += {"(": 1, ")": -1}.get(self.now.text, 0) if self.now.kind == "op" else 0
            self.take()
        source = None
        if self.accept("FROM"):
            self.db.register()
            text, types = self._source()(Scope())
            own = next(c.split(".")[0] for c in types if "." in c)
            frame = self.db.spark.sql(f"SELECT * FROM {text}")
            source = frame.toDF(*(f"_from_{c}" for c in frame.columns))
            for c in frame.columns:
                for k in (f"{own}.{c.lower()}", c.lower()):
                    if k not in scope.types:
                        scope.types[k], scope.names[k] = types[c.lower()], name(f"_from_{c}")
        after, self.i = self.i, at
        changes = self._assignments(scope)
        self.i = after
        where = self._column(self.expr(), scope) if self.accept("WHERE") else None
        back = self.i
        returning = self._skip_returning()
        order, limit, offset = self._tail(scope)
        if source is not None:
            touched = self.db.update(table, changes, source=source, on=where if where is not None else F.lit(True))
        else:
            touched = self.db.update(table, changes, where, order=order, limit=limit, offset=offset)
        return self._reread(returning, back, touched, table, alias)

    def _skip_returning(self) -> bool:
        """RETURNING comes before ORDER BY but is evaluated after the change: pass over it."""
        if not self.accept("RETURNING"):
            return False
        self.listed(self._item)
        return True

    def _reread(self, returning: bool, at: int, touched: DataFrame, table: str, alias: str | None) -> DataFrame | None:
        if not returning:
            return None
        end, self.i = self.i, at
        out = self._returning(touched, self._scope(table, alias))
        self.i = end
        return out

    def _delete(self) -> DataFrame | None:
        self.expect("FROM")
        table = self._name()
        alias = self.identifier() if self.accept("AS") else None
        scope = self._scope(table, alias)
        where = None
        if self.accept("WHERE"):
            where = self.expr()
            self.db.register()
            text = fn.condition(where(scope))
            if "SELECT" in text:  # a subquery: Catalyst plans it as a semi join over the table
                hits = self.db.spark.sql(f"SELECT * FROM {name(table)} AS {name(alias or table)} WHERE {text}")
                key = list(self.db.state.tables[table.lower()].primary_key or hits.columns)
                marked = hits.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).distinct().withColumn("_hit", F.lit(True))
                back = self.i
                returning = self._skip_returning()
                old = self.db.table(table)
                same = F.lit(True)
                for i, k in enumerate(key):
                    same = same & old[k].eqNullSafe(marked[f"_k{i}"])
                touched = self.db._swap(self.db.state.tables[table.lower()], old.join(marked, same, "left_anti"), old.join(marked, same, "left_semi"), "delete")
                return self._reread(returning, back, touched, table, alias)
            condition: Column | None = F.expr(text)
        else:
            condition = None
        back = self.i
        returning = self._skip_returning()
        order, limit, offset = self._tail(scope)
        touched = self.db.delete(table, condition, order=order, limit=limit, offset=offset)
        return self._reread(returning, back, touched, table, alias)

    # DDL ---------------------------------------------------------------------------------------------------------

    def _create(self) -> None:
        temp = self.accept("TEMP") or self.accept("TEMPORARY")
        unique = self.accept("UNIQUE")
        what = self.take().word
        quiet = self.accept("IF", "NOT", "EXISTS")
        n = self._name()
        if what == "VIEW":
            columns = None
            if self.accept("("):
                columns = self.listed(self.identifier)
                self.expect(")")
            self.expect("AS")
            if not (quiet and n.lower() in self.db.state.views):
                self.db.create_view(n, self._frame(self.query()), columns)
            else:
                self.query()
        elif what == "INDEX":
            self.expect("ON")
            table = self._name()
            self.expect("(")
            scope = self._scope(table)
            columns = [c.strip("`") for c in self.listed(lambda: self.order_term()(scope).rsplit(" NULLS", 1)[0].rsplit(" ", 1)[0])]
            self.expect(")")
            where = fn.condition(self.expr()(scope)) if self.accept("WHERE") else None
            if not (quiet and n.lower() in self.db.state.indexes):
                self.db.create_index(Index(n, table, tuple(columns), unique, where))
        elif what == "TABLE":
            if self.accept("AS"):
                df = self._frame(self.query())
                if not (quiet and n.lower() in self.db.state.tables):
                    self.db.create_table_as(n, df, temp)
            else:
                self.db.create_table(self._table(n, temp), quiet)
        elif what == "TRIGGER":
            self._trigger(n, quiet)
        else:
            raise SyntaxError(f"near {what!r}: syntax error")

    def _trigger(self, n: str, quiet: bool) -> None:
        """[BEFORE | AFTER] event [OF columns] ON table [FOR EACH ROW] [WHEN test] BEGIN statements END.

        The body runs for all changed rows at once: INSERT takes a row for each of them, UPDATE and DELETE the rows that
        meet any of them, and SELECT RAISE(ABORT, text) [WHERE test] stops the statement if it holds for one.
        """
        begin = self.now.at
        timing = "before" if self.accept("BEFORE") else (self.accept("AFTER"), "after")[1]
        event = self.take().word.lower()
        of = tuple(self.listed(self.identifier)) if self.accept("OF") else ()
        self.expect("ON")
        table = self._name()
        self.accept("FOR", "EACH", "ROW")
        when = self.expr() if self.accept("WHEN") else None
        self.expect("BEGIN")
        bodies, start, depth = [], self.i, 0
        while not (self.now.word == "END" and depth == 0):
            if self.now.kind == "end":
                raise SyntaxError("a trigger's body needs END")
            depth += {"CASE": 1, "END": -1}.get(self.now.word, 0)
            if self.take().text == ";" and depth == 0:
                bodies.append(self.tokens[start : self.i - 1])
                start = self.i
        self.expect("END")
        scope = Scope(names={})
        for side, prefix in (("old", "_before_"), ("new", "_after_")):
            for c, k in self.db.table(table).dtypes:
                scope.types[f"{side}.{c.lower()}"], scope.names[f"{side}.{c.lower()}"] = kind(k), name(f"{prefix}{c}")
        test = fn.condition(when(scope)) if when else None
        text, columns = self.sql, self.db.table(table).dtypes

        def body(db: Database, rows: DataFrame) -> None:
            for tokens in bodies:
                TriggerBody(db, text, tokens, rows, columns).run()

        if not (quiet and n.lower() in self.db.state.triggers):
            self.db.create_trigger(Trigger(n, table, timing, event, body, test, of, pairs=True, sql=f"CREATE TRIGGER {n} {text[begin : self.tokens[self.i - 1].at + 3]}"))

    def _table(self, n: str, temp: bool) -> Table:
        """( column definitions and table constraints ) options."""
        self.expect("(")
        columns: list[ColumnDef] = []
        parts: dict[str, list] = {"key": [], "unique": [], "checks": [], "foreign": []}
        later: list[tuple[str, object]] = []
        auto = False
        while True:
            self.accept("CONSTRAINT") and self.identifier()
            if self.now.word in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
                self._table_constraint(parts, later)
            else:
                c = self.identifier()
                fields: dict = {"type": self.type_name()}
                while not (self.now.kind == "op" and self.now.text in (",", ")")):
                    auto |= self._column_constraint(c, fields, parts, later)
                columns.append(ColumnDef(c, **fields))
            if not self.accept(","):
                break
        self.expect(")")
        strict = without = False
        while self.now.word in ("STRICT", "WITHOUT"):
            if self.accept("WITHOUT", "ROWID"):
                without = True
            else:
                self.expect("STRICT")
                strict = True
            self.accept(",")
        scope = Scope(self._typed(n, [(c.name, kind(Database._type(c, strict))) for c in columns]), names={f"{n.lower()}.{c.name.lower()}": name(c.name) for c in columns})
        for target, x in later:
            if target == "check":
                parts["checks"].append(fn.condition(x(scope)))
            else:
                what, c = target.split(":", 1)
                columns = [ColumnDef(**{**d.__dict__, what: x(scope)[0]}) if d.name == c else d for d in columns]
        return Table(n, tuple(columns), tuple(parts["key"]), tuple(parts["unique"]), tuple(parts["checks"]), tuple(parts["foreign"]), strict, without, auto, temp)

    def _names(self) -> tuple[str, ...]:
        self.expect("(")
        out = self.listed(lambda: (self.identifier(), self.accept("ASC") or self.accept("DESC"))[0])
        self.expect(")")
        return tuple(out)

    def _table_constraint(self, parts: dict, later: list) -> None:
        if self.accept("PRIMARY", "KEY"):
            parts["key"] = list(self._names())
        elif self.accept("UNIQUE"):
            parts["unique"].append(self._names())
        elif self.accept("CHECK", "("):
            later.append(("check", self.expr()))
            self.expect(")")
        else:
            self.expect("FOREIGN", "KEY")
            parts["foreign"].append(self._references(self._names()))

    def _references(self, columns: tuple[str, ...]) -> ForeignKey:
        self.expect("REFERENCES")
        parent = self.identifier()
        key = self._names() if self.now.text == "(" else self.db.state.tables[parent.lower()].primary_key
        actions: dict = {}
        while self.now.word in ("ON", "MATCH", "DEFERRABLE", "INITIALLY") or (self.now.word == "NOT" and self.ahead().word == "DEFERRABLE"):
            if self.accept("ON"):
                event = self.take().word.lower()
                first = self.take().word.lower()
                actions[f"on_{event}"] = first if first in ("cascade", "restrict") else f"{first} {self.take().word.lower()}"
            elif self.accept("MATCH"):
                actions["match"] = self.take().word.lower()
            elif self.accept("INITIALLY"):
                actions["deferred"] = self.take().word == "DEFERRED" and actions.get("deferred") is not None
            else:
                actions["deferred"] = None if self.accept("NOT", "DEFERRABLE") else self.accept("DEFERRABLE") and False
        actions["deferred"] = bool(actions.get("deferred"))
        return ForeignKey(columns, parent, key, **actions)

    def _column_constraint(self, c: str, fields: dict, parts: dict, later: list) -> bool:
        """True for AUTOINCREMENT."""
        self.accept("CONSTRAINT") and self.identifier()
        if self.accept("PRIMARY", "KEY"):
            parts["key"] = [c]
            self.accept("ASC") or self.accept("DESC")
            return self.accept("AUTOINCREMENT")
        if self.accept("NOT", "NULL"):
            fields["not_null"] = True
        elif self.accept("NULL"):
            pass
        elif self.accept("UNIQUE"):
            parts["unique"].append((c,))
        elif self.accept("DEFAULT"):
            later.append((f"default:{c}", self.unary()))
        elif self.accept("CHECK", "("):
            later.append(("check", self.expr()))
            self.expect(")")
        elif self.accept("COLLATE"):
            fields["collation"] = self.identifier().upper()
        elif self.now.word == "REFERENCES":
            parts["foreign"].append(self._references((c,)))
        elif self.accept("GENERATED", "ALWAYS", "AS", "(") or self.accept("AS", "("):
            later.append((f"generated:{c}", self.expr()))
            self.expect(")")
            self.accept("STORED") or self.accept("VIRTUAL")
        else:
            raise SyntaxError(f"near {self.now.text!r}: syntax error")
        return False

    def _drop(self) -> None:
        what = self.take().word.lower()
        quiet = self.accept("IF", "EXISTS")
        self.db.drop(what, self._name(), quiet)

    def _alter(self) -> None:
        self.expect("TABLE")
        table = self._name()
        if self.accept("RENAME", "TO"):
            self.db.rename_table(table, self.identifier())
        elif self.accept("RENAME"):
            self.accept("COLUMN")
            old = self.identifier()
            self.expect("TO")
            self.db.rename_column(table, old, self.identifier())
        elif self.accept("DROP"):
            self.accept("COLUMN")
            self.db.drop_column(table, self.identifier())
        else:
            self.expect("ADD")
            self.accept("COLUMN")
            c = self.identifier()
            fields: dict = {"type": self.type_name()}
            later: list = []
            while self.now.kind != "end" and self.now.text != ";":
                self._column_constraint(c, fields, {"key": [], "unique": [], "checks": [], "foreign": []}, later)
            scope = self._scope(table)
            fields |= {target.split(":")[0]: x(scope)[0] for target, x in later if ":" in target}
            self.db.add_column(table, ColumnDef(c, **fields))

    # Transactions, pragmas ---------------------------------------------------------------------------------------

    def _begin(self) -> None:
        mode = self.take().word.lower() if self.now.word in ("DEFERRED", "IMMEDIATE", "EXCLUSIVE") else "deferred"
        self.accept("TRANSACTION")
        isolation = "serializable"
        if self.accept("ISOLATION", "LEVEL"):
            words = [self.take().word.lower()]
            while self.now.kind == "name":
                words.append(self.take().word.lower())
            isolation = " ".join(words)
        self.db.begin(mode, isolation)

    def _commit(self) -> None:
        self.accept("TRANSACTION")
        self.db.commit()

    _end = _commit

    def _rollback(self) -> None:
        self.accept("TRANSACTION")
        if self.accept("TO"):
            self.accept("SAVEPOINT")
            self.db.rollback_to(self.identifier())
        else:
            self.db.rollback()

    def _savepoint(self) -> None:
        self.db.savepoint(self.identifier())

    def _release(self) -> None:
        self.accept("SAVEPOINT")
        self.db.release(self.identifier())

    def _pragma(self) -> DataFrame:
        n = self._name()
        value = None
        if self.accept("=") or (bracket := self.accept("(")):
            sign = "-" if self.accept("-") else ""
            t = self.take()
            value = int(sign + t.text) if t.kind == "number" else t.text
            if "bracket" in locals() and bracket:
                self.expect(")")
        return self.db.pragma(n, value)

    def _analyze(self) -> None:
        if self.now.kind in ("name", "quoted"):
            self._name()
        self.db.analyze()

    _reindex = _vacuum = _analyze


class TriggerBody(Statements):
    """One statement of a trigger's body over the changed rows, which it names NEW and OLD."""

    def __init__(self, db: Database, sql: str, tokens: list[Token], rows: DataFrame, columns: list[tuple[str, str]]) -> None:
        super().__init__(db, "")
        self.sql, self.tokens, self.rows, self.columns = sql, [*tokens, Token("end", "", len(sql))], rows, columns
        self.view = f"_rows_{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(self.view)

    def _sides(self) -> dict[str, tuple[str, str]]:
        """NEW's and OLD's columns: their type and their column in the view."""
        return {f"{side}.{c.lower()}": (kind(k), f"{self.view}.{name(prefix + c)}") for side, prefix in (("old", "_before_"), ("new", "_after_")) for c, k in self.columns}

    def _scope(self, table: str, alias: str | None = None) -> Scope:
        scope = super()._scope(table, alias)
        for key, (k, text) in self._sides().items():
            scope.types[key], scope.names[key] = k, text.split(".", 1)[1]
        return scope

    def _outer(self) -> Scope:
        sides = self._sides()
        return Scope({k: v[0] for k, v in sides.items()}, names={k: v[1] for k, v in sides.items()})

    def _frame(self, query) -> DataFrame:
        """A query for each changed row: VALUES and SELECT without aggregates over them become one join."""
        self.db.register()
        scope = self._outer()
        self.outer_names = scope.names
        text, out = query(scope)
        columns = ", ".join(name(f"_q{k}") for k in range(len(out)))
        return self.db.spark.sql(f"SELECT {columns} FROM {self.view}, LATERAL ({text}) AS _q({columns})")

    def run(self) -> None:
        if self.accept("SELECT", "RAISE", "("):
            action = self.take().word
            message = self.take().text if self.accept(",") else ""
            self.expect(")")
            test = fn.condition(self.expr()(self._outer())) if self.accept("WHERE") else "true"
            if action != "IGNORE" and not self.db.spark.sql(f"SELECT 1 FROM {self.view} WHERE {test}").isEmpty():
                raise ConstraintError(message)
            return
        depth, self.db._depth = self.db._depth, self.db._depth
        try:
            self.statement()
        finally:
            self.db._depth = depth

    def _update(self) -> None:
        self._policy()
        table = self._name()
        self.expect("SET")
        scope = self._scope(table)
        changes = self._assignments(scope)
        on = self._column(self.expr(), scope) if self.accept("WHERE") else F.lit(True)
        self.db.update(table, changes, source=self.rows, on=on)

    def _delete(self) -> None:
        self.expect("FROM")
        table = self._name()
        on = self._column(self.expr(), self._scope(table)) if self.accept("WHERE") else F.lit(True)
        old = dml.ordered(self.db.table(table), dml.ROW)
        met = old.join(self.rows, on, "left_semi")
        left = old.join(met.select(dml.ROW), dml.ROW, "left_anti")
        self.db._swap(self.db.state.tables[table.lower()], left.drop(dml.ROW), met.drop(dml.ROW), "delete")
