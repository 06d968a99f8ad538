"""Windows: specs by parts, GROUPS frames, EXCLUDE and FILTER on top of Spark's ROWS and RANGE frames.

GROUPS counts peer groups: with d = dense_rank() over the same partition and order, GROUPS BETWEEN a AND b is RANGE
BETWEEN a AND b over d, so it costs one more window over the same sort.

Frames from a bound to UNBOUNDED FOLLOWING would be evaluated anew for each row. They are turned round: over the
reversed order they begin at UNBOUNDED PRECEDING, which Spark evaluates by running sums, in one pass.

EXCLUDE: for sums, counts and averages over any frame, the excluded rows' share is subtracted (the current row's value,
or its peers' within the frame), which needs no list of the frame. For other functions over bounded frames the frame's
values are collected with row and group numbers and filtered (memory: the frame).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = None  # as a frame's bound


@dataclass(frozen=True)
class Spec:
    """PARTITION BY, ORDER BY and a frame (unit rows, range or groups; bounds relative to the current row)."""

    partition: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    unit: str | None = None
    low: float | None = None
    high: float | None = 0
    exclude: str | None = None  # current row, group, ties or no others
    keys: tuple[str, ...] = field(default=())  # the plain names of order, for peers
    reverse: tuple[Column, ...] = field(default=())  # the opposite order, needed where order has directions of its own

    def extend(self, order: Sequence[Column] = (), keys: Sequence[str] = (), **frame: object) -> Spec:
        """A named window as a base: (w ORDER BY ... frame). Order and frame can be added, not changed."""
        if (order and self.order) or (frame and self.unit):
            raise ValueError("cannot override ORDER BY or frame specification of window")
        return replace(self, order=tuple(order) or self.order, keys=tuple(keys) or self.keys, **frame)

    def base(self) -> WindowSpec:
        w = Window.partitionBy(*self.partition)
        return w.orderBy(*self.order) if self.order else w


def _bound(n: float | None, low: bool) -> float:
    return (Window.unboundedPreceding if low else Window.unboundedFollowing) if n is None else n


def _reversed(c: Column) -> Column:
    """The opposite order of a plain column, whose own order is ascending with nulls first."""
    if re.search(r" NULLS (FIRST|LAST)'>$", str(c)):
        raise ValueError("order by plain columns, or give reverse")
    return c.desc_nulls_last()


def _turned(s: Spec) -> bool:
    return s.low is not None and s.high is None


def spec(s: Spec, ordered: bool = False) -> WindowSpec:
    """The Spark window of a spec with a ROWS, RANGE or default frame.

    ordered: for functions that depend on the order within the frame (first_value, collect_list). Others get frames up
    to UNBOUNDED FOLLOWING turned round.
    """
    if s.unit is None:
        return s.base()
    if s.unit not in ("rows", "range"):
        raise ValueError("a GROUPS frame needs over()")
    if _turned(s) and not ordered and s.order:
        back = s.reverse or tuple(_reversed(c) for c in s.order)
        return _between(Window.partitionBy(*s.partition).orderBy(*back), s.unit, None, -s.low)
    return _between(s.base(), s.unit, s.low, s.high)


def _between(w: WindowSpec, unit: str, low: float | None, high: float | None) -> WindowSpec:
    a, b = _bound(low, True), _bound(high, False)
    return w.rowsBetween(a, b) if unit == "rows" else w.rangeBetween(a, b)


def _numbered(df: DataFrame, s: Spec) -> DataFrame:
    """df with _d, the peer group's number, and _n, the row's number, in the window's order."""
    out = df.withColumn("_d", F.dense_rank().over(s.base()) if s.order else F.lit(1))
    return out.withColumn("_n", F.row_number().over(s.base()) if s.order else F.row_number().over(Window.partitionBy(*s.partition).orderBy(F.lit(1))))


def _frame(s: Spec, ordered: bool = False) -> WindowSpec:
    """The frame over the numbers of _numbered()."""
    if s.unit not in ("groups", "rows"):
        return spec(s, ordered)
    w, number, unit = Window.partitionBy(*s.partition), *(("_d", "range") if s.unit == "groups" else ("_n", "rows"))
    if _turned(s) and not ordered:
        return _between(w.orderBy(F.desc(number)), unit, None, -s.low)
    return _between(w.orderBy(number), unit, s.low, s.high)


def over(df: DataFrame, name: str, function: Callable[[Column], Column], x: Column, s: Spec, where: Column | None = None) -> DataFrame:
    """df with name = function(x) [FILTER (WHERE where)] OVER s, for any frame and EXCLUDE.

    function: an aggregate such as F.sum, or with EXCLUDE one of EXCLUDING by name.
    """
    value = x if where is None else F.when(where, x)
    if s.exclude in (None, "no others"):
        if s.unit != "groups":
            return df.withColumn(name, function(value).over(spec(s)))
        return _numbered(df, s).withColumn(name, function(value).over(_frame(s))).drop("_d", "_n")
    inner = EXCLUDING[function.__name__]
    cells = F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_d").alias("d"), value.alias("v"))).over(_frame(s, ordered=True))
    n, d = F.col("_n"), F.col("_d")
    keep = {"current row": lambda c: c["n"] != n, "group": lambda c: c["d"] != d, "ties": lambda c: (c["d"] != d) | (c["n"] == n)}[s.exclude]
    return _numbered(df, s).withColumn("_c", cells).withColumn(name, inner(F.transform(F.filter("_c", lambda c: keep(c) & c["v"].isNotNull()), lambda c: c["v"]))).drop("_c", "_d", "_n")


def over_all(df: DataFrame, found: Mapping[str, tuple[Callable[[Column], Column], Column, Spec]]) -> DataFrame:
    """df with name = function(x) OVER s for each (function, x, s); the specs share partition and order."""
    first = next(iter(found.values()))[2]
    out = _numbered(df, first) if any(s.unit == "groups" for _, _, s in found.values()) else df
    cells = {n: f(x).over(_frame(s) if s.unit == "groups" else spec(s)) for n, (f, x, s) in found.items()}
    return out.withColumns(cells).drop("_d", "_n")


def _sum(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")))


EXCLUDING: dict[str, Callable[[Column], Column]] = {
    "sum": _sum,
    "count": lambda v: F.size(v).cast("long"),
    "avg": lambda v: _sum(v) / F.size(v),
    "min": F.array_min,
    "max": F.array_max,
}


def excluded_sum(df: DataFrame, name: str, x: Column, s: Spec) -> DataFrame:
    """SUM(x) OVER a running or whole frame with EXCLUDE, without lists: the frame's sum less what is left out.

    For frames that hold all peers of the current row (RANGE and GROUPS up to the current row or further, or whole
    partitions) and for EXCLUDE CURRENT ROW over any frame that holds the current row. NULL if nothing is left.
    """
    peers = Window.partitionBy(*s.partition, *s.keys)
    out = _numbered(df, s)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    all_sum, all_n = zero(F.sum(x).over(_frame(s))), F.count(x).over(_frame(s))
    own, own_n = zero(x.cast("double")), F.when(x.isNull(), 0).otherwise(1)
    group, group_n = zero(F.sum(x).over(peers)), F.count(x).over(peers)
    gone, gone_n = {"current row": (own, own_n), "group": (group, group_n), "ties": (group - own, group_n - own_n)}[s.exclude or ""]
    return out.withColumn(name, F.when(all_n - gone_n > 0, all_sum - gone)).drop("_d", "_n")


def group_concat_over(x: Column, w: WindowSpec, separator: str = ",") -> Column:
    """GROUP_CONCAT OVER, in the frame's order."""
    parts = F.collect_list(x.cast("string")).over(w)
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def json_group_array_over(x: Column, w: WindowSpec) -> Column:
    """JSON_GROUP_ARRAY OVER of numbers, in the frame's order, NULLs kept."""
    parts = F.transform(F.collect_list(F.struct(x.alias("v"))).over(w), lambda s: F.coalesce(s["v"].cast("string"), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def total_over(x: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.sum(x.cast("double")).over(w), F.lit(0.0))
