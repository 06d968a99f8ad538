"""Relational operators of the dialect as DataFrame constructions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.session import stage


# Sources ---------------------------------------------------------------------------------------------------------


def values(spark: SparkSession, rows: Sequence[Sequence[object]], columns: Sequence[str] | None = None) -> DataFrame:
    """VALUES (...), (...): columns column1 .. columnN unless named; rows of one width."""
    widths = {len(r) for r in rows}
    if len(widths) != 1:
        raise ValueError("all VALUES must have the same number of terms")
    names = list(columns or (f"column{i + 1}" for i in range(widths.pop())))
    return spark.createDataFrame([tuple(r) for r in rows], names)


def single_row(spark: SparkSession) -> DataFrame:
    """SELECT without FROM: one row without columns."""
    return spark.range(1).select()


def with_rowid(df: DataFrame, order: Sequence[str | Column], name: str = "rowid") -> DataFrame:
    """df with dense row ids from 1 in a total order.

    Range-partitioned: a sort over all tasks, counts by partition, and row numbers within; never one task. The sorted
    rows are staged with their places: Spark samples the ranges' bounds anew whenever it plans the same rows again, so
    counts and numbers must come from one run.
    """
    spark = df.sparkSession
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")  # the partition's number, then 33 bits of the row's
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).count()
    bases = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = placed.withColumn("_p", part).join(F.broadcast(bases), "_p")
    return numbered.withColumn(name, (F.col("_base") + own + 1).cast("long")).drop("_p", "_at", "_base")


# Projection ------------------------------------------------------------------------------------------------------


def where_alias(df: DataFrame, aliases: dict[str, Column], condition: Column) -> DataFrame:
    """WHERE over select aliases: the aliases become columns before the filter; Catalyst merges both."""
    return df.withColumns(aliases).where(condition)


# Joins -----------------------------------------------------------------------------------------------------------


def join_using(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: one copy of each column, the left one unless the row has no left side."""
    return left.join(right, list(columns), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: USING all common columns; a cross join if there is none."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def semi_join(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    """EXISTS and IN (SELECT)."""
    return left.join(right, condition, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, condition, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """x NOT IN (SELECT y), NULL-aware: nothing if right has a NULL; a NULL x passes only an empty right.

    Two small facts about right (is it empty, has it a NULL) are joined as one row, so that the anti join itself is an
    equality join that Spark can hash or sort; Spark's own NULL-aware anti join would be a nested loop on large sides.
    """
    facts = right.agg(F.count("*").alias("_n"), F.count(F.when(F.col(other).isNull(), 1)).alias("_nulls"))
    kept = left.join(right.select(F.col(other).alias("_y")), left[column] == F.col("_y"), "left_anti")
    passes = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())
    return kept.join(F.broadcast(facts)).where(passes).drop("_n", "_nulls")


def scalar(df: DataFrame) -> DataFrame:
    """A scalar subquery's frame: one column, first row; joined to a query as a one-row broadcast."""
    if len(df.columns) != 1:
        raise ValueError("sub-select returns more than one column")
    return df.limit(1)


# Sets ------------------------------------------------------------------------------------------------------------


def compound(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """a op b op c, strictly from the left. Operators: union, union all, intersect, except. Names of the first."""
    out = first
    for op, df in rest:
        if len(df.columns) != len(out.columns):
            raise ValueError("SELECTs to the left and right do not have the same number of result columns")
        op = " ".join(op.lower().split())
        out = {"union all": lambda a, b: a.union(b), "union": lambda a, b: a.union(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[op](out, df)
    return out


# Order and limit -------------------------------------------------------------------------------------------------


def order_key(x: Column, descending: bool = False, nulls: str | None = None) -> Column:
    """An ORDER BY term: NULLs first ascending and last descending unless said."""
    nulls = nulls or ("last" if descending else "first")
    return {(False, "first"): x.asc_nulls_first, (False, "last"): x.asc_nulls_last, (True, "first"): x.desc_nulls_first, (True, "last"): x.desc_nulls_last}[(descending, nulls.lower())]()


def limit(df: DataFrame, count: int | float, offset: int | float = 0) -> DataFrame:
    """LIMIT and OFFSET: a negative limit is none, a negative offset 0; reals must be whole."""
    for n in (count, offset):
        if int(n) != n:
            raise ValueError("datatype mismatch")
    out = df.offset(int(offset)) if offset > 0 else df
    return out.limit(int(count)) if count >= 0 else out


# Indexes ---------------------------------------------------------------------------------------------------------


def index_layout(df: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by an index's columns: written so, row groups have narrow ranges and pushed
    filters skip the rest."""
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def duplicates(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that break a unique index; keys with a NULL never do."""
    rows = df if where is None else df.where(where)
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*columns).count().where("count > 1")


def expression_name(text: str) -> str:
    """The output name of an unnamed expression: a column's last path segment, else the text."""
    m = re.fullmatch(r"(?:\w+\.)*(\w+)", text.strip())
    return m[1] if m else text.strip()
