"""A database of DataFrames: catalog, data changes with constraints, triggers, transactions and pragmas.

Tables are immutable DataFrames in a map; a statement makes new ones and swaps them in, so a transaction is a copy of
the map and a savepoint another. Tables are staged in the shared folder after each change: plans stay short and
executors can be lost. save() and open() keep the tables as Parquet folders with a JSON catalog, a version for each
save; readers of an older version are undisturbed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.operators import affinity, lit
from ferrule.operators import dml
from ferrule.operators.relational import index_layout, with_rowid
from ferrule.session import stage


class ConstraintError(Exception):
    """A statement breaks a constraint; nothing was changed."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str = ""
    not_null: bool = False
    default: str | None = None  # a Spark SQL expression
    generated: str | None = None  # a Spark SQL expression over other columns
    collation: str = "BINARY"


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "no action"  # or cascade, set null, set default, restrict
    on_update: str = "no action"
    match: str = "none"  # kept for foreign_key_list; a key with a NULL is always fine
    deferred: bool = False  # checked at the end of a transaction


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    strict: bool = False
    without_rowid: bool = False
    autoincrement: bool = False
    temp: bool = False


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    where: str | None = None


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    timing: str  # before or after
    event: str  # insert, update or delete
    body: Callable[[Database, DataFrame], None]  # gets the changed rows; of an UPDATE those after it
    when: str | None = None
    of: tuple[str, ...] = ()
    pairs: bool = False  # body gets columns _before_x and _after_x instead (NULL before an INSERT and after a DELETE)
    sql: str | None = None


@dataclass(frozen=True)
class State:
    """All that a transaction can undo."""

    tables: Mapping[str, Table] = field(default_factory=dict)
    data: Mapping[str, DataFrame] = field(default_factory=dict)
    views: Mapping[str, DataFrame] = field(default_factory=dict)
    indexes: Mapping[str, Index] = field(default_factory=dict)
    triggers: Mapping[str, Trigger] = field(default_factory=dict)
    sequences: Mapping[str, int] = field(default_factory=dict)


#: Pragma names by kind, with first values for flags and knobs.
FLAGS = {"foreign_keys": 0, "defer_foreign_keys": 0, "read_uncommitted": 0, "query_only": 0, "count_changes": 0, "recursive_triggers": 0, "ignore_check_constraints": 0, "case_sensitive_like": 0, "reverse_unordered_selects": 0}
KNOBS = {
    "page_size": 4096, "page_count": 0, "max_page_count": 1073741823, "freelist_count": 0, "user_version": 0, "application_id": 0, "schema_version": 0, "trusted_schema": 1, "encoding": "UTF-8", "data_version": 1,
    "journal_mode": "memory", "synchronous": 2, "cache_size": -2000, "cache_spill": 1, "temp_store": 0, "locking_mode": "normal", "secure_delete": 0, "wal_autocheckpoint": 1000, "wal_checkpoint": 0, "mmap_size": 0,
    "auto_vacuum": 0, "busy_timeout": 0, "analysis_limit": 0, "journal_size_limit": -1, "soft_heap_limit": 0, "hard_heap_limit": 0, "threads": 0, "automatic_index": 1, "cell_size_check": 0, "full_column_names": 0,
    "short_column_names": 1, "fullfsync": 0, "checkpoint_fullfsync": 0, "empty_result_callbacks": 0,
}
NOOPS = ("optimize", "shrink_memory", "incremental_vacuum")
SCHEMA_PRAGMAS = ("database_list", "collation_list", "quick_check", "integrity_check", "function_list", "compile_options", "pragma_list", "module_list", "stats", "table_list", "foreign_key_check", "table_info", "table_xinfo", "index_list", "index_info", "index_xinfo", "foreign_key_list")
READ_ONLY = ("page_count", "freelist_count", "data_version")


def _sides(rows: DataFrame, event: str) -> DataFrame:
    """Inserted or deleted rows as columns _before_x and _after_x."""
    side = lambda name, has: [(F.col(c) if has else F.lit(None).cast(k)).alias(f"{name}{c}") for c, k in rows.dtypes]
    return rows.select(*side("_before_", event != "insert"), *side("_after_", event != "delete"))


class Database:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.state = spark, State()
        self._begun: State | None = None
        self._savepoints: list[tuple[str, State]] = []
        self.settings: dict[str, int | str] = {**FLAGS, **KNOBS}
        self.changes = self.total_changes = 0
        self.last_insert_rowid: int | None = None
        self._depth = 0

    # Names -------------------------------------------------------------------------------------------------------

    def _set(self, **parts: Mapping) -> None:
        self.state = replace(self.state, **parts)

    def table(self, name: str) -> DataFrame:
        """A table, view or catalog relation."""
        key = name.lower().removeprefix("main.").removeprefix("temp.")
        if key in ("sqlite_master", "sqlite_schema", "sqlite_temp_master", "sqlite_temp_schema"):
            return self.master(temp="temp" in key)
        found = self.state.data.get(key, self.state.views.get(key))
        if found is None:
            raise KeyError(f"no such table: {name}")
        return found

    def register(self) -> None:
        """Make all tables and views known to spark.sql under their names."""
        for name, df in {**self.state.data, **self.state.views}.items():
            df.createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        """A query in the dialect; rows of the last statement of a batch."""
        from ferrule.sql.statements import run

        out = run(self, sql)
        if out is None:
            raise ValueError("query() takes statements that return rows")
        return out

    def execute(self, sql: str) -> None:
        """Statements in the dialect, in order."""
        from ferrule.sql.statements import run

        run(self, sql)

    def indexed_by(self, table: str, index: str) -> DataFrame:
        """t INDEXED BY i: checks the name; the scan is the same."""
        key = table.lower()
        if key in self.state.views:
            raise ValueError("INDEXED BY is not allowed on a view")
        if index.lower() not in self.state.indexes or self.state.indexes[index.lower()].table != key:
            raise KeyError(f"no such index: {index}")
        return self.table(table)

    def not_indexed(self, table: str) -> DataFrame:
        return self.table(table)

    # DDL ---------------------------------------------------------------------------------------------------------

    def _free(self, name: str, exists: bool) -> bool:
        taken = name.lower() in {**self.state.tables, **self.state.views, **self.state.indexes}
        if taken and not exists:
            raise ValueError(f"{name} already exists")
        return not taken

    def create_table(self, table: Table, if_not_exists: bool = False) -> None:
        if not self._free(table.name, if_not_exists):
            return
        key = table.name.lower()
        kinds = ", ".join(f"`{c.name}` {self._type(c, table.strict)}" for c in table.columns)
        self._set(tables={**self.state.tables, key: table}, data={**self.state.data, key: self.spark.createDataFrame([], kinds)})
        self._bump()

    @staticmethod
    def _type(c: ColumnDef, strict: bool) -> str:
        if strict and c.type.upper() not in ("INT", "INTEGER", "REAL", "TEXT", "BLOB", "ANY"):
            raise ValueError(f"unknown datatype for {c.name}: {c.type!r}")
        return "string" if c.type.upper() == "ANY" else affinity(c.type)

    def create_table_as(self, name: str, df: DataFrame, temp: bool = False) -> None:
        self._free(name, False)
        names = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "BOOLEAN"}
        table = Table(name, tuple(ColumnDef(c, names.get(k, k)) for c, k in df.dtypes), temp=temp)
        self._set(tables={**self.state.tables, name.lower(): table}, data={**self.state.data, name.lower(): stage(df, "table")})
        self._bump()

    def attach(self, table: Table, df: DataFrame) -> None:
        """A table over existing data, e.g. a Parquet scan."""
        self._free(table.name, False)
        self._set(tables={**self.state.tables, table.name.lower(): table}, data={**self.state.data, table.name.lower(): df})
        self._bump()

    def create_view(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> None:
        self._free(name, False)
        self._set(views={**self.state.views, name.lower(): df.toDF(*columns) if columns else df})
        self._bump()

    def create_index(self, index: Index, layout: bool = False) -> None:
        """Metadata, and for a unique index a check. layout: rewrite the table range-partitioned and sorted by it."""
        self._free(index.name, False)
        key = index.table.lower()
        index = replace(index, table=key)
        if index.unique:
            self._unique(self.table(key), index.columns, index.where, index.name)
        if layout:
            self._set(data={**self.state.data, key: stage(index_layout(self.table(key), index.columns), "table")})
        self._set(indexes={**self.state.indexes, index.name.lower(): index})
        self._bump()

    def create_trigger(self, trigger: Trigger) -> None:
        if trigger.timing not in ("before", "after") or trigger.event not in ("insert", "update", "delete"):
            raise ValueError("a trigger is before or after an insert, update or delete")
        self._set(triggers={**self.state.triggers, trigger.name.lower(): replace(trigger, table=trigger.table.lower())})
        self._bump()

    def drop(self, kind: str, name: str, if_exists: bool = False) -> None:
        """DROP TABLE, VIEW, INDEX or TRIGGER."""
        part, key = {"table": "tables", "view": "views", "index": "indexes", "trigger": "triggers"}[kind], name.lower()
        if key not in getattr(self.state, part):
            if if_exists:
                return
            raise KeyError(f"no such {kind}: {name}")
        without = lambda m: {k: v for k, v in m.items() if k != key}
        self._set(**{part: without(getattr(self.state, part))})
        if kind == "table":
            own = lambda m: {k: v for k, v in m.items() if v.table != key}
            self._set(data=without(self.state.data), indexes=own(self.state.indexes), triggers=own(self.state.triggers))
        self._bump()

    def _alter(self, name: str, table: Table, df: DataFrame) -> None:
        key = name.lower()
        self._set(tables={**self.state.tables, key: table}, data={**self.state.data, key: df})
        self._bump()

    def add_column(self, name: str, column: ColumnDef) -> None:
        table, df = self.state.tables[name.lower()], self.table(name)
        if column.not_null and column.default is None:
            raise ValueError("Cannot add a NOT NULL column with default value NULL")
        value = F.expr(column.generated or column.default or "NULL").cast(self._type(column, table.strict))
        self._alter(name, replace(table, columns=(*table.columns, column)), df.withColumn(column.name, value))

    def drop_column(self, name: str, column: str) -> None:
        table = self.state.tables[name.lower()]
        if column in table.primary_key or any(column in u for u in table.unique):
            raise ValueError(f'error in table {name}: cannot drop PRIMARY KEY or UNIQUE column: "{column}"')
        self._alter(name, replace(table, columns=tuple(c for c in table.columns if c.name != column)), self.table(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        table = self.state.tables[name.lower()]
        swap = lambda cs: tuple(new if c == old else c for c in cs)
        word = lambda text: re.sub(rf"\b{re.escape(old)}\b", new, text)
        changed = replace(table, columns=tuple(replace(c, name=new) if c.name == old else c for c in table.columns), primary_key=swap(table.primary_key), unique=tuple(map(swap, table.unique)), checks=tuple(map(word, table.checks)))
        self._alter(name, changed, self.table(name).withColumnRenamed(old, new))
        self._set(indexes={k: replace(i, columns=swap(i.columns)) if i.table == name.lower() else i for k, i in self.state.indexes.items()})

    def rename_table(self, old: str, new: str) -> None:
        self._free(new, False)
        key, to = old.lower(), new.lower()
        move = lambda m: {to if k == key else k: v for k, v in m.items()}
        self._set(tables={k: replace(v, name=new) if k == to else v for k, v in move(self.state.tables).items()}, data=move(self.state.data))
        follow = lambda m: {k: replace(v, table=to) if v.table == key else v for k, v in m.items()}
        self._set(indexes=follow(self.state.indexes), triggers=follow(self.state.triggers))
        self._bump()

    def _bump(self) -> None:
        self.settings["schema_version"] = int(self.settings["schema_version"]) + 1

    # Constraints -------------------------------------------------------------------------------------------------

    def _fail(self, message: str) -> None:
        raise ConstraintError(message)

    def _unique(self, df: DataFrame, columns: Sequence[str], where: str | None, name: str) -> None:
        if not dml.unique_violations(df, columns, F.expr(where) if where else None).isEmpty():
            self._fail(f"UNIQUE constraint failed: {name}.{', '.join(columns)}")

    def _keys(self, table: Table) -> list[tuple[tuple[str, ...], str | None]]:
        """All unique keys with their partial conditions."""
        own = [(k, None) for k in ((table.primary_key,) if table.primary_key else ()) + table.unique]
        return own + [(i.columns, i.where) for i in self.state.indexes.values() if i.table == table.name.lower() and i.unique]

    def check_rows(self, table: Table, rows: DataFrame) -> None:
        """NOT NULL, CHECK and foreign keys of changed rows."""
        needed = [c.name for c in table.columns if c.not_null] + (list(table.primary_key) if table.without_rowid or table.strict else [])
        if needed and not dml.not_null_violations(rows, needed).isEmpty():
            self._fail(f"NOT NULL constraint failed: {table.name}.{needed[0] if len(needed) == 1 else ', '.join(needed)}")
        if not self.settings["ignore_check_constraints"]:
            for check in table.checks:
                if not dml.check_violations(rows, F.expr(check)).isEmpty():
                    self._fail(f"CHECK constraint failed: {check}")
        if self.settings["foreign_keys"] and not self.settings["defer_foreign_keys"]:
            for fk in table.foreign_keys:
                if fk.deferred and self._begun is not None:
                    continue
                if not dml.foreign_key_violations(rows, fk.columns, self.table(fk.parent), fk.parent_columns).isEmpty():
                    self._fail("FOREIGN KEY constraint failed")

    def _check_table(self, table: Table, df: DataFrame) -> None:
        for columns, where in self._keys(table):
            self._unique(df, columns, where, table.name)

    def _referenced(self, name: str) -> list[tuple[Table, ForeignKey]]:
        """The tables' keys that refer to a table, if foreign keys are on."""
        if not self.settings["foreign_keys"]:
            return []
        return [(t, fk) for t in self.state.tables.values() for fk in t.foreign_keys if fk.parent.lower() == name]

    def _orphans(self, name: str, before: DataFrame, after: DataFrame) -> None:
        """ON DELETE of the children of rows that are gone from a parent table."""
        for child, fk in self._referenced(name):
            olds = [f"_old{i}" for i in range(len(fk.columns))]
            gone = before.select(*fk.parent_columns).subtract(after.select(*fk.parent_columns)).toDF(*olds)
            self._act(child, fk, gone, fk.on_delete)

    def _followers(self, name: str, pairs: DataFrame, after: DataFrame) -> None:
        """ON UPDATE of the children of rows with new keys. pairs: the parent's columns as _before_x and _after_x."""
        for child, fk in self._referenced(name):
            olds, news = [f"_old{i}" for i in range(len(fk.columns))], [f"_new{i}" for i in range(len(fk.columns))]
            moved = F.lit(False)
            for p in fk.parent_columns:
                moved = moved | ~F.col(f"_before_{p}").eqNullSafe(F.col(f"_after_{p}"))
            changed = pairs.where(moved).select(*(F.col(f"_before_{p}").alias(o) for p, o in zip(fk.parent_columns, olds)), *(F.col(f"_after_{p}").alias(n) for p, n in zip(fk.parent_columns, news)))
            if fk.on_update in ("no action", "restrict"):  # another row may have taken the key over
                there = after.select(*(F.col(p).alias(o) for p, o in zip(fk.parent_columns, olds)))
                changed = changed.join(there, olds, "left_anti")
            self._act(child, fk, changed, fk.on_update)

    def _act(self, child: Table, fk: ForeignKey, keys: DataFrame, action: str) -> None:
        """A foreign key's action on the child rows of some parent keys: _old0.., and _new0.. for ON UPDATE."""
        rows = self.table(child.name)
        keys = stage(keys, "keys")
        same = [F.col(c) == F.col(f"_old{i}") for i, c in enumerate(fk.columns)]
        hit = stage(rows.join(keys, same), "children")
        if hit.isEmpty():
            return
        if action in ("no action", "restrict"):
            if not (fk.deferred and self._begun is not None and action == "no action"):
                self._fail("FOREIGN KEY constraint failed")
            return
        rest = rows.join(keys, same, "left_anti")
        if action == "cascade" and "_new0" not in keys.columns:
            self._swap(child, rest, hit.select(*rows.columns), "delete")
            return
        defaults = {c.name: c.default for c in child.columns}
        value = {
            "cascade": lambda i, c: F.col(f"_new{i}"),
            "set null": lambda i, c: F.lit(None),
            "set default": lambda i, c: F.expr(defaults[c] or "NULL"),
        }[action]
        new = hit.withColumns({c: value(i, c).cast(rows.schema[c].dataType) for i, c in enumerate(fk.columns)}).select(*rows.columns)
        self._swap(child, rest.unionByName(new), new, "update", list(fk.columns))

    # Data changes ------------------------------------------------------------------------------------------------

    def _fire(self, table: str, timing: str, event: str, rows: DataFrame, changed: Sequence[str] = (), pairs: DataFrame | None = None) -> None:
        if self._depth and not self.settings["recursive_triggers"]:
            return
        for t in list(self.state.triggers.values()):
            if (t.table, t.timing, t.event) == (table, timing, event) and (not t.of or set(t.of) & set(changed)):
                own = rows if not t.pairs else pairs if event == "update" and pairs is not None else _sides(rows, event)
                own = own.where(t.when) if t.when else own
                self._depth += 1
                try:
                    if not own.isEmpty():
                        t.body(self, own)
                finally:
                    self._depth -= 1

    def _swap(self, table: Table, df: DataFrame, touched: DataFrame, event: str, changed: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
        """Put a table's new rows in place if constraints allow; else everything is as before the statement.

        pairs: of an UPDATE, the columns before and after it, row by row, for foreign keys and triggers.
        """
        if self.settings["query_only"]:
            raise ValueError("attempt to write a readonly database")
        key, before = table.name.lower(), self.state
        try:
            touched = stage(touched, "touched")
            self._fire(key, "before", event, touched, changed, pairs)
            if event != "delete":
                self.check_rows(table, touched)
            df = stage(df, "table")
            if event != "delete":
                self._check_table(table, df)
            old = self.state.data[key]
            self._set(data={**self.state.data, key: df})
            if event == "delete":
                self._orphans(key, old, df)
            elif event == "update" and pairs is not None:
                self._followers(key, pairs, df)
            self._fire(key, "after", event, touched, changed, pairs)
        except Exception:
            self.state = before
            raise
        if not self._depth:
            self.changes = touched.count()
            self.total_changes += self.changes
        return touched

    def insert(self, name: str, rows: DataFrame | Sequence[Sequence[object]] | None = None, columns: Sequence[str] | None = None, conflict: str = "abort", on_conflict: Sequence[str] | None = None, set_: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
        """INSERT; returns the touched rows (RETURNING is a select on them). rows None: DEFAULT VALUES.

        conflict: abort, fail, rollback, ignore or replace. on_conflict: a key for DO NOTHING, or with set_ DO UPDATE.
        """
        table, old = self.state.tables[name.lower()], self.table(name)
        plain = [c.name for c in table.columns if not c.generated]
        if rows is None:
            rows, columns = self.spark.range(1).select(), []
        if not isinstance(rows, DataFrame):
            names = list(columns or plain)
            if any(len(r) != len(names) for r in rows):
                raise ValueError(f"table {name} has {len(names)} columns but other numbers of values were supplied")
            rows = self.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` {old.schema[n].dataType.simpleString()}" for n in names))
        elif columns is not None:
            rows = rows.toDF(*columns)
        defaults = {c.name: F.expr(c.default) for c in table.columns if c.default}
        new = dml.fill(dml.ordered(rows), old, defaults, {c.name: F.expr(c.generated) for c in table.columns if c.generated})
        new = self._numbered(table, old, new)
        keys = self._keys(table)
        if on_conflict is not None:
            if tuple(on_conflict) not in [k for k, _ in keys]:
                raise ValueError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
            df, touched = dml.upsert(old, new, on_conflict, set_, where) if set_ else dml.insert_or_ignore(old, new, on_conflict)
        elif conflict in ("ignore", "replace") and keys:
            df, touched = old, new
            for columns_, _ in keys:
                ranked = touched
                if conflict == "ignore":
                    touched = dml.first_by_key(ranked, columns_, [dml.ORDER]).join(old.select(*columns_), list(columns_), "left_anti").select(*ranked.columns)
                else:
                    touched = dml.first_by_key(ranked, columns_, [dml.ORDER], last=True)
                    df = df.join(touched.select(*columns_).distinct(), list(columns_), "left_anti").select(*old.columns)
            touched = touched.select(*old.columns)
            df = (old if conflict == "ignore" else df).unionByName(touched)
        else:
            touched = new.drop(dml.ORDER)
            df = dml.insert(old, touched)
        try:
            touched = self._swap(table, df, touched, "insert")
        except ConstraintError:
            if conflict == "rollback" and self._begun is not None:
                self.rollback()
            raise
        if table.primary_key and len(table.primary_key) == 1 and dict(old.dtypes)[table.primary_key[0]] == "bigint" and not table.without_rowid:
            self.last_insert_rowid = touched.agg(F.max(table.primary_key[0])).first()[0]
        return touched

    def _numbered(self, table: Table, old: DataFrame, new: DataFrame) -> DataFrame:
        """New rows whose INTEGER PRIMARY KEY is NULL get the next ids."""
        if table.without_rowid or len(table.primary_key) != 1 or dict(old.dtypes)[table.primary_key[0]] != "bigint":
            return new
        key = table.primary_key[0]
        missing = new.where(F.col(key).isNull())
        if missing.isEmpty():
            return new
        top = max(old.agg(F.max(key)).first()[0] or 0, new.agg(F.max(key)).first()[0] or 0, self.state.sequences.get(table.name.lower(), 0) if table.autoincrement else 0)
        numbered = dml.running_number(missing, top, [dml.ORDER], key).select(*new.columns)
        if table.autoincrement:
            self._set(sequences={**self.state.sequences, table.name.lower(): top + missing.count()})
        return new.where(F.col(key).isNotNull()).unionByName(numbered)

    def _changes(self, table: Table, set_: Mapping[str, Column | object]) -> dict[str, Column]:
        generated = {c.name for c in table.columns if c.generated}
        if generated & set(set_):
            raise ValueError("cannot UPDATE generated column")
        return {c: lit(v) for c, v in set_.items()}

    def _regenerate(self, table: Table, df: DataFrame) -> DataFrame:
        for c in table.columns:
            if c.generated:
                df = df.withColumn(c.name, F.expr(c.generated).cast(df.schema[c.name].dataType))
        return df

    def update(self, name: str, set_: Mapping[str, Column | object], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None, key: Sequence[str] | None = None, order: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
        """UPDATE [FROM source] [ORDER BY LIMIT OFFSET]; returns the changed rows."""
        table, old = self.state.tables[name.lower()], self.table(name)
        changes = self._changes(table, set_)
        follow = self._referenced(name.lower()) or any(t.table == name.lower() and t.event == "update" for t in self.state.triggers.values())
        rows = dml.ordered(old, dml.ROW) if follow or limit is not None or not (key or table.primary_key) else old
        key = [dml.ROW] if dml.ROW in rows.columns else list(key or table.primary_key)
        if source is not None:
            df, touched = dml.update_from(rows, source, on if where is None else on & where, changes, key)
        elif limit is not None:
            df, touched = dml.update_limited(rows, key, changes, where, [*order, F.col(dml.ROW)], limit, offset)
        else:
            df, touched = dml.update(rows, changes, where)
        df, touched = self._regenerate(table, df), self._regenerate(table, touched)
        pairs = None
        if follow:
            touched = stage(touched, "touched")
            before = rows.select(dml.ROW, *(F.col(c).alias(f"_before_{c}") for c in old.columns))
            pairs = stage(before.join(touched.select(dml.ROW, *(F.col(c).alias(f"_after_{c}") for c in old.columns)), dml.ROW).drop(dml.ROW), "pairs")
        return self._swap(table, df.drop(dml.ROW), touched.drop(dml.ROW), "update", list(set_), pairs)

    def delete(self, name: str, where: Column | None = None, key: Sequence[str] | None = None, order: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
        """DELETE [ORDER BY LIMIT OFFSET]; returns the deleted rows."""
        table, old = self.state.tables[name.lower()], self.table(name)
        df, gone = dml.delete_limited(old, None, where, order, limit, offset) if limit is not None else dml.delete(old, where)
        return self._swap(table, df, gone, "delete")

    # Transactions ------------------------------------------------------------------------------------------------

    def begin(self, mode: str = "deferred", isolation: str = "serializable") -> None:
        if mode not in ("deferred", "immediate", "exclusive") or isolation not in ("read committed", "repeatable read", "serializable"):
            raise ValueError("no such transaction mode")
        if self._begun is not None:
            raise ValueError("cannot start a transaction within a transaction")
        self._begun = self.state

    def commit(self) -> None:
        if self._begun is None:
            raise ValueError("cannot commit - no transaction is active")
        if self.settings["foreign_keys"] and (self.settings["defer_foreign_keys"] or any(fk.deferred for t in self.state.tables.values() for fk in t.foreign_keys)):
            if not self.pragma("foreign_key_check").isEmpty():
                self._fail("FOREIGN KEY constraint failed")
        self._begun, self._savepoints = None, []
        self.settings["defer_foreign_keys"] = 0

    end = commit

    def rollback(self) -> None:
        if self._begun is None:
            raise ValueError("cannot rollback - no transaction is active")
        self.state, self._begun, self._savepoints = self._begun, None, []

    def savepoint(self, name: str) -> None:
        self._savepoints.append((name.lower(), self.state))

    def _savepoint(self, name: str) -> int:
        found = [i for i, (n, _) in enumerate(self._savepoints) if n == name.lower()]
        if not found:
            raise KeyError(f"no such savepoint: {name}")
        return found[-1]

    def rollback_to(self, name: str) -> None:
        i = self._savepoint(name)
        self.state, self._savepoints = self._savepoints[i][1], self._savepoints[: i + 1]

    def release(self, name: str) -> None:
        self._savepoints = self._savepoints[: self._savepoint(name)]

    def analyze(self) -> None:
        """ANALYZE, REINDEX and VACUUM: accepted, nothing to do."""

    reindex = vacuum = analyze

    # Introspection -----------------------------------------------------------------------------------------------

    def _rows(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def ddl(self, name: str) -> str:
        """A CREATE TABLE text."""
        t = self.state.tables[name.lower()]
        parts = []
        for c in t.columns:
            words = [c.name, c.type] + ["NOT NULL"] * c.not_null + ([f"DEFAULT {c.default}"] if c.default else []) + ([f"GENERATED ALWAYS AS ({c.generated})"] if c.generated else []) + ([f"COLLATE {c.collation}"] if c.collation != "BINARY" else [])
            parts.append(" ".join(w for w in words if w))
        parts += [f"PRIMARY KEY ({', '.join(t.primary_key)})"] * bool(t.primary_key) + [f"UNIQUE ({', '.join(u)})" for u in t.unique] + [f"CHECK ({c})" for c in t.checks]
        for f in t.foreign_keys:
            words = [f"FOREIGN KEY ({', '.join(f.columns)}) REFERENCES {f.parent} ({', '.join(f.parent_columns)})"]
            words += [f"ON DELETE {f.on_delete.upper()}"] * (f.on_delete != "no action") + [f"ON UPDATE {f.on_update.upper()}"] * (f.on_update != "no action")
            words += [f"MATCH {f.match.upper()}"] * (f.match != "none") + ["DEFERRABLE INITIALLY DEFERRED"] * f.deferred
            parts.append(" ".join(words))
        tail = ", ".join(["STRICT"] * t.strict + ["WITHOUT ROWID"] * t.without_rowid)
        return f"CREATE {'TEMP ' * t.temp}TABLE {t.name} ({', '.join(parts)})" + (f" {tail}" if tail else "")

    def master(self, temp: bool = False) -> DataFrame:
        s = self.state
        rows = [("table", t.name, t.name, 0, self.ddl(k)) for k, t in s.tables.items() if t.temp == temp]
        if not temp:
            rows += [("view", k, k, 0, None) for k in s.views]
            rows += [("index", i.name, i.table, 0, f"CREATE {'UNIQUE ' * i.unique}INDEX {i.name} ON {i.table} ({', '.join(i.columns)})") for i in s.indexes.values()]
            rows += [("trigger", t.name, t.table, 0, t.sql) for t in s.triggers.values()]
        return self._rows("type string, name string, tbl_name string, rootpage long, sql string", rows)

    def explain(self, df: DataFrame) -> DataFrame:
        """EXPLAIN QUERY PLAN: (id, detail), a row for each line of the physical plan."""
        plan = df._jdf.queryExecution().simpleString()
        return self._rows("id long, detail string", list(enumerate(x for x in plan.split("\n") if x.strip())))

    def pragma(self, name: str, value: int | str | None = None) -> DataFrame:
        """A pragma's rows; with a value, a flag or knob is set first. pragma_xxx(arg) in FROM is the same frame."""
        name = name.lower()
        name = name if name in SCHEMA_PRAGMAS else name.removeprefix("pragma_")
        if name in NOOPS:
            return self._rows(f"{name} long", [])
        if name in self.settings:
            if value is not None and name not in READ_ONLY:
                words = {"on": 1, "yes": 1, "true": 1, "off": 0, "no": 0, "false": 0}
                self.settings[name] = words.get(str(value).lower(), value) if name in FLAGS else value
            now = self.settings[name]
            return self._rows(f"{name} {'string' if isinstance(now, str) else 'long'}", [(now,)])
        if name not in SCHEMA_PRAGMAS:
            return self._rows(f"{name} string", [])
        return getattr(self, f"_pragma_{name}")(value)

    def _pragma_database_list(self, _) -> DataFrame:
        return self._rows("seq long, name string, file string", [(0, "main", ""), (1, "temp", "")])

    def _pragma_collation_list(self, _) -> DataFrame:
        return self._rows("seq long, name string", list(enumerate(("RTRIM", "NOCASE", "BINARY"))))

    def _pragma_integrity_check(self, _) -> DataFrame:
        """ok, or a row for each broken constraint of stored rows."""
        found = []
        for t in self.state.tables.values():
            try:
                self.check_rows(t, self.table(t.name))
                self._check_table(t, self.table(t.name))
            except ConstraintError as e:
                found.append((str(e),))
        return self._rows("integrity_check string", found or [("ok",)])

    def _pragma_quick_check(self, v) -> DataFrame:
        return self._pragma_integrity_check(v).withColumnRenamed("integrity_check", "quick_check")

    def _pragma_function_list(self, _) -> DataFrame:
        import inspect

        from ferrule.functions import dates, jsons, maths, nulls, strings

        names = sorted({n.strip("_") for m in (dates, jsons, maths, nulls, strings) for n, f in inspect.getmembers(m, inspect.isfunction) if f.__module__ == m.__name__ and not n.startswith("_")})
        return self._rows("name string, builtin long, type string, enc string, narg long, flags long", [(n, 1, "s", "utf8", -1, 0) for n in names])

    def _pragma_compile_options(self, _) -> DataFrame:
        from ferrule.functions.nulls import COMPILE_OPTIONS

        return self._rows("compile_options string", [(o,) for o in COMPILE_OPTIONS])

    def _pragma_pragma_list(self, _) -> DataFrame:
        return self._rows("name string", [(n,) for n in sorted((*FLAGS, *KNOBS, *NOOPS, *SCHEMA_PRAGMAS))])

    def _pragma_module_list(self, _) -> DataFrame:
        return self._rows("name string", [(f"pragma_{n}",) for n in SCHEMA_PRAGMAS])

    def _pragma_stats(self, _) -> DataFrame:
        return self._rows("tbl string, idx string, wdth long, hght long, flgs long", [(t.name, None, len(t.columns), 0, 0) for t in self.state.tables.values()])

    def _pragma_table_list(self, _) -> DataFrame:
        s = self.state
        rows = [("temp" if t.temp else "main", t.name, "table", len(t.columns), int(t.without_rowid), int(t.strict)) for t in s.tables.values()]
        return self._rows("schema string, name string, type string, ncol long, wr long, strict long", rows + [("main", k, "view", len(v.columns), 0, 0) for k, v in s.views.items()])

    def _table_info(self, name: str, hidden: bool) -> list[tuple]:
        t = self.state.tables.get(str(name).lower())
        if t is None:
            return [(i, c, k, 0, None, 0, 0) for i, (c, k) in enumerate(self.table(name).dtypes)]
        place = {c: i + 1 for i, c in enumerate(t.primary_key)}
        return [(i, c.name, c.type, int(c.not_null), c.default, place.get(c.name, 0), 2 if c.generated else 0) for i, c in enumerate(c for c in t.columns if hidden or not c.generated)]

    def _pragma_table_info(self, name) -> DataFrame:
        return self._rows("cid long, name string, type string, notnull long, dflt_value string, pk long", [r[:6] for r in self._table_info(name, False)])

    def _pragma_table_xinfo(self, name) -> DataFrame:
        return self._rows("cid long, name string, type string, notnull long, dflt_value string, pk long, hidden long", self._table_info(name, True))

    def _pragma_index_list(self, name) -> DataFrame:
        own = [i for i in self.state.indexes.values() if i.table == str(name).lower()]
        return self._rows("seq long, name string, unique long, origin string, partial long", [(k, i.name, int(i.unique), "c", int(bool(i.where))) for k, i in enumerate(own)])

    def _index_columns(self, name: str) -> list[tuple[int, int, str]]:
        i = self.state.indexes[str(name).lower()]
        places = {c: k for k, c in enumerate(self.table(i.table).columns)}
        return [(k, places.get(c, -2), c) for k, c in enumerate(i.columns)]

    def _pragma_index_info(self, name) -> DataFrame:
        return self._rows("seqno long, cid long, name string", self._index_columns(name))

    def _pragma_index_xinfo(self, name) -> DataFrame:
        rows = [(*r, 0, "BINARY", 1) for r in self._index_columns(name)]
        return self._rows("seqno long, cid long, name string, desc long, coll string, key long", [*rows, (len(rows), -1, None, 0, "BINARY", 0)])

    def _pragma_foreign_key_list(self, name) -> DataFrame:
        t = self.state.tables[str(name).lower()]
        rows = [(k, seq, f.parent, a, b, f.on_update.upper(), f.on_delete.upper(), f.match.upper()) for k, f in enumerate(t.foreign_keys) for seq, (a, b) in enumerate(zip(f.columns, f.parent_columns))]
        return self._rows("id long, seq long, table string, from string, to string, on_update string, on_delete string, match string", rows)

    def _pragma_foreign_key_check(self, name) -> DataFrame:
        """(table, rowid, parent, fkid): a row for each child row without parent; rowid is its place, or its integer key."""
        out = self._rows("table string, rowid long, parent string, fkid long", [])
        for t in self.state.tables.values():
            if name is None or t.name.lower() == str(name).lower():
                rows = self.table(t.name)
                whole = len(t.primary_key) == 1 and dict(rows.dtypes)[t.primary_key[0]] == "bigint"
                numbered = rows.withColumn(dml.ROW, F.col(t.primary_key[0])) if whole else with_rowid(dml.ordered(rows), [dml.ORDER], dml.ROW)
                for k, f in enumerate(t.foreign_keys):
                    bad = dml.foreign_key_violations(numbered, f.columns, self.table(f.parent), f.parent_columns)
                    out = out.union(bad.select(F.lit(t.name), F.col(dml.ROW).cast("long"), F.lit(f.parent), F.lit(k).cast("long")))
        return out

    # Files -------------------------------------------------------------------------------------------------------

    def save(self, path: str) -> int:
        """A new version of the whole database under path; older versions stay. The catalog is written last, and only
        a version with a catalog counts."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        versions = self._versions(path)
        version = max(versions, default=0) + 1
        for key, df in self.state.data.items():
            df.write.parquet(f"{path}/v{version}/{key}")
        catalog = {"tables": [asdict(t) for t in self.state.tables.values()], "indexes": [asdict(i) for i in self.state.indexes.values()], "sequences": dict(self.state.sequences)}
        target = hadoop(f"{path}/v{version}/catalog.json")
        out = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(json.dumps(catalog).encode()))
        out.close()
        return version

    def _versions(self, path: str) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(hadoop(f"{path}/{n}/catalog.json"))]

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Database:
        db = cls(spark)
        version = version or max(db._versions(path), default=0)
        if not version:
            raise FileNotFoundError(path)
        catalog = json.loads(spark.read.text(f"{path}/v{version}/catalog.json", wholetext=True).first()[0])
        for t in catalog["tables"]:
            lists = {k: tuple(tuple(x) if isinstance(x, list) else x for x in t[k]) for k in ("primary_key", "unique", "checks")}
            keys = tuple(ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in t["foreign_keys"])
            table = Table(**{**t, **lists, "columns": tuple(ColumnDef(**c) for c in t["columns"]), "foreign_keys": keys})
            db._set(tables={**db.state.tables, table.name.lower(): table}, data={**db.state.data, table.name.lower(): spark.read.parquet(f"{path}/v{version}/{table.name.lower()}")})
        db._set(indexes={i["name"].lower(): Index(**{**i, "columns": tuple(i["columns"])}) for i in catalog["indexes"]}, sequences=catalog["sequences"])
        return db
