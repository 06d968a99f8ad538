"""Data changes as copy-on-write DataFrame transforms: each returns the new table and, where asked, the affected rows.

Keys with a NULL never conflict, as in unique indexes. Joins on keys are equality joins. Rows count in the order in which
they are given: ordered() numbers them, and of several new rows with one key the first or last by that number is meant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import stage


#: A column with the place of a new row among the rows of its statement, and one that names a row of a table.
ORDER, ROW = "_ord", "_rid"


def ordered(rows: DataFrame, name: str = ORDER) -> DataFrame:
    """rows with their place in the input, staged, so that it stays the same however often they are read."""
    return stage(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def fill(rows: DataFrame, like: DataFrame, defaults: Mapping[str, Column] | None = None, generated: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with all columns of a table: missing ones from defaults (else NULL), generated ones computed; its types."""
    given, defaults, generated = set(rows.columns) - {ORDER}, defaults or {}, generated or {}
    kept = [ORDER] if ORDER in rows.columns else []
    if bad := given & set(generated):
        raise ValueError(f"cannot INSERT into generated column {sorted(bad)[0]!r}")
    if bad := given - set(like.columns):
        raise ValueError(f"table has no column named {sorted(bad)[0]}")
    for f in like.schema.fields:
        if f.name not in given and f.name not in generated:
            rows = rows.withColumn(f.name, defaults.get(f.name, F.lit(None)).cast(f.dataType))
    for name, x in generated.items():
        rows = rows.withColumn(name, x)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields), *kept)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT VALUES, INSERT SELECT."""
    return table.unionByName(rows)


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) in an order; rows with a NULL in the key all stay.

    The row is the minimum of (order, row) as a struct: pre-aggregated, so many rows of one key don't meet in a task.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    packed = F.struct(*(s.alias(f"_o{i}") for i, s in enumerate(sort)), F.struct(*rows.columns).alias("_row"))
    best = rows.where(known).groupBy(*keys).agg((F.max if last else F.min)(packed).alias("_b")).select("_b._row.*")
    return best.select(*rows.columns).unionByName(rows.where(~known))


def _place(rows: DataFrame, order: Sequence[str | Column] | None) -> tuple[DataFrame, Sequence[str | Column]]:
    """rows and the order that counts: the one given, else that of the input."""
    if order is not None:
        return rows, order
    return (rows if ORDER in rows.columns else ordered(rows)), [ORDER]


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT OR IGNORE and ON CONFLICT DO NOTHING: (table, inserted rows). The first of several new rows stays."""
    rows, order = _place(rows, order)
    new = first_by_key(rows, keys, order).join(table.select(*keys), list(keys), "left_anti").select(*table.columns)
    return table.unionByName(new), new


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT OR REPLACE and REPLACE INTO: new rows push out old ones with their key, the last of several new ones stays."""
    rows, order = _place(rows, order)
    new = first_by_key(rows, keys, order, last=True).select(*table.columns)
    kept = table.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns)
    return kept.unionByName(new), new


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], changes: Mapping[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT (keys) DO UPDATE SET changes [WHERE where]: (table, inserted and updated rows).

    changes and where speak of the old row by column names and of the new one by names with the prefix excluded_ .
    Several new rows with one key work one after the other: a round for the first ones of all keys, a round for the
    second ones, and so on, each over the table that the one before left.
    """
    rows, _ = _place(rows, None)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    turn = F.when(known, F.row_number().over(Window.partitionBy(*keys).orderBy(ORDER))).otherwise(1)
    turns = stage(rows.withColumn("_turn", turn), "turns")
    last = turns.agg(F.max("_turn")).first()[0] or 1
    touched = None
    for n in range(1, last + 1):
        table, own = _upsert_once(table, turns.where(F.col("_turn") == n).drop("_turn", ORDER), keys, changes, where)
        if n < last:
            table, own = stage(table, "table"), stage(own, "touched")
        touched = own if touched is None else touched.unionByName(own)
    return table, touched


def _upsert_once(table: DataFrame, new: DataFrame, keys: Sequence[str], changes: Mapping[str, Column], where: Column | None) -> tuple[DataFrame, DataFrame]:
    named = new.select(*(F.col(c).alias(f"excluded_{c}") for c in new.columns), F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"excluded_{k}") for k in keys]
    both = table.withColumn("_old", F.lit(True)).join(named, on, "full")
    met = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    hit = met if where is None else met & F.coalesce(where, F.lit(False))
    out = both.select(
        *(F.when(hit, changes[c].cast(table.schema[c].dataType) if c in changes else F.col(c)).when(F.col("_old").isNull(), F.col(f"excluded_{c}")).otherwise(F.col(c)).alias(c) for c in table.columns),
        (hit | F.col("_old").isNull()).alias("_touched"),
    )
    return out.drop("_touched"), out.where("_touched").drop("_touched")


def update(table: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE SET ... WHERE: (table, changed rows). All new values are computed from the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    cells = [F.when(F.col("_hit"), changes[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns]
    out = table.withColumn("_hit", hit).select(*cells, "_hit")
    return out.drop("_hit"), out.where("_hit").drop("_hit")


def update_from(table: DataFrame, source: DataFrame, on: Column, changes: Mapping[str, Column], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """UPDATE ... FROM source: a row that meets several source rows takes the least of them by all columns.

    key: columns that identify table's rows. source: columns with names of their own.
    """
    met = table.select(*key, *(c for c in table.columns if c not in key)).join(source, on)
    chosen = met.groupBy(*key).agg(F.min(F.struct(*source.columns)).alias("_s")).select(*(F.col(k).alias(f"_k_{k}") for k in key), "_s.*", F.lit(True).alias("_met"))
    same = F.lit(True)
    for k in key:
        same = same & table[k].eqNullSafe(F.col(f"_k_{k}"))
    both = table.join(chosen, same, "left")
    cells = [F.when(F.col("_met"), changes[c].cast(table.schema[c].dataType)).otherwise(table[c]).alias(c) if c in changes else table[c] for c in table.columns]
    out = both.select(*cells, F.coalesce("_met", F.lit(False)).alias("_hit"))
    return out.drop("_hit"), out.where("_hit").drop("_hit")


def delete(table: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE WHERE: (table, deleted rows)."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)


def limited(table: DataFrame, where: Column | None, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows that UPDATE or DELETE ... ORDER BY ... LIMIT ... OFFSET touch. The order must be total."""
    rows = table if where is None else table.where(where)
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit >= 0 else rows


def _without(table: DataFrame, key: Sequence[str], gone: DataFrame) -> DataFrame:
    """The rows of table that aren't in gone, by key; NULLs in it are equal."""
    named = gone.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return table.join(named, same, "left_anti")


def delete_limited(table: DataFrame, key: Sequence[str] | None, where: Column | None, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """DELETE ... ORDER BY ... LIMIT: (table, deleted rows). key identifies rows; None: their places in the table do, and
    decide between rows that the order leaves equal."""
    if key is None:
        left, gone = delete_limited(ordered(table, ROW), [ROW], where, [*order, F.col(ROW)], limit, offset)
        return left.drop(ROW), gone.drop(ROW)
    gone = stage(limited(table, where, order, limit, offset), "gone")
    return _without(table, key, gone), gone


def update_limited(table: DataFrame, key: Sequence[str] | None, changes: Mapping[str, Column], where: Column | None, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """UPDATE ... ORDER BY ... LIMIT: (table, changed rows), with key as in delete_limited."""
    if key is None:
        left, new = update_limited(ordered(table, ROW), [ROW], changes, where, [*order, F.col(ROW)], limit, offset)
        return left.drop(ROW), new.drop(ROW)
    touched = stage(limited(table, where, order, limit, offset), "touched")
    new = update(touched, changes)[0]
    return _without(table, key, touched).unionByName(new), new


# Constraints: each gives the offending rows; a statement passes if there are none. ---------------------------------


def not_null_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return rows.where(bad)


def check_violations(rows: DataFrame, check: Column) -> DataFrame:
    """CHECK passes on true and NULL."""
    return rows.where(~F.coalesce(check, F.lit(True)))


def unique_violations(rows: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    from ferrule.operators.relational import duplicates

    return duplicates(rows, keys, where)


def foreign_key_violations(rows: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Rows whose key, if it has no NULL, has no parent."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    keys = parent.select(*(F.col(p).alias(f"_p_{c}") for c, p in zip(columns, parent_columns)))
    return rows.where(known).join(keys, [F.col(c) == F.col(f"_p_{c}") for c in columns], "left_anti")


def running_number(rows: DataFrame, start: int, order: Sequence[str | Column], name: str) -> DataFrame:
    """rows numbered from start + 1, for ids of new rows."""
    from ferrule.operators.relational import with_rowid

    return with_rowid(rows.drop(name), order, name).withColumn(name, F.col(name) + start)


def latest(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The newest version of each key of a change log."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
