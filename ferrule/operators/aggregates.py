"""Aggregates of the dialect that Spark lacks or spells otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions import jsons
from ferrule.functions.operators import lit


def filtered(x: Column, where: Column | None) -> Column:
    """The argument of aggregate(x) FILTER (WHERE ...)."""
    return x if where is None else F.when(where, x)


def count_rows(where: Column | None = None) -> Column:
    """COUNT(*) and COUNT()."""
    return F.count(filtered(F.lit(1), where))


def count(x: Column, distinct: bool = False, where: Column | None = None) -> Column:
    return (F.count_distinct if distinct else F.count)(filtered(x, where))


def sum_(x: Column, distinct: bool = False, where: Column | None = None) -> Column:
    """Integers stay integers and overflow is an error; NULL over no rows."""
    return (F.sum_distinct if distinct else F.sum)(filtered(x, where))


def total(x: Column, where: Column | None = None) -> Column:
    """Always real, 0.0 over no rows."""
    return F.coalesce(F.sum(filtered(x, where).cast("double")), F.lit(0.0))


def avg(x: Column, distinct: bool = False, where: Column | None = None) -> Column:
    x = filtered(x, where)
    if distinct:
        return F.sum_distinct(x).cast("double") / F.nullif(F.count_distinct(x), F.lit(0))
    return F.avg(x)


def min_(x: Column, where: Column | None = None) -> Column:
    return F.min(filtered(x, where))


def max_(x: Column, where: Column | None = None) -> Column:
    return F.max(filtered(x, where))


def _collected(x: Column, order: list[Column] | None) -> Column:
    """All x (NULLs too) of a group as structs, by the order keys (ascending) and then by x."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order or [])]
    return F.array_sort(F.collect_list(F.struct(*keys, x.alias("v"))))


def group_concat(x: Column, separator: str = ",", order: list[Column] | None = None, distinct: bool = False, where: Column | None = None) -> Column:
    """GROUP_CONCAT and STRING_AGG: NULLs skipped, NULL over none; by the order keys, else by value (the dialect leaves
    the order open). DISTINCT takes no separator."""
    if distinct and separator != ",":
        raise ValueError("DISTINCT aggregates must have exactly one argument")
    x = filtered(x, where).cast("string")
    if distinct:
        parts = F.array_sort(F.collect_set(x))
    else:
        parts = F.transform(F.filter(_collected(x, order), lambda s: s["v"].isNotNull()), lambda s: s["v"])
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


string_agg = group_concat


def median(x: Column) -> Column:
    return F.median(x)


def percentile(x: Column, p: float) -> Column:
    """p from 0 to 100, interpolated."""
    return F.percentile(x, p / 100.0)


def percentile_cont(x: Column, fraction: float) -> Column:
    return F.percentile(x, fraction)


def percentile_disc(column: str, fraction: float) -> Column:
    """The first value, in order, whose share of rows reaches fraction. A group's state is its distinct values' counts."""
    return F.expr(f"percentile_disc({float(fraction)!r}) WITHIN GROUP (ORDER BY {column})")


def decimal_sum(x: Column, scale: int = 10) -> Column:
    """An exact sum of numbers or numeric texts, as text without trailing zeros."""
    exact = F.sum(x.try_cast(f"decimal(38,{scale})")).cast("string")
    return F.when(exact.contains("."), F.regexp_replace(exact, r"\.?0+$", "")).otherwise(exact)


def json_group_array(x: Column, kind: str = "other", order: list[Column] | None = None, where: Column | None = None) -> Column:
    """A JSON array with NULLs kept as null. kind: string, json, boolean or other."""
    text = jsons._element(x, kind)
    items = _collected(text if where is None else F.when(where, text), order)
    items = F.transform(items, lambda s: s["v"])
    items = items if where is None else F.filter(items, lambda v: v.isNotNull())
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_group_object(key: Column, x: Column, kind: str = "other", order: list[Column] | None = None) -> Column:
    """A JSON object; duplicate keys stay."""
    pair = F.concat(jsons.json_quote(key.cast("string")), F.lit(":"), jsons._element(x, kind))
    items = F.transform(_collected(pair, order if order is not None else [key]), lambda s: s["v"])
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def jsonb_group_array(x: Column, kind: str = "other", order: list[Column] | None = None) -> Column:
    return F.parse_json(json_group_array(x, kind, order))


def jsonb_group_object(key: Column, x: Column, kind: str = "other", order: list[Column] | None = None) -> Column:
    return F.parse_json(json_group_object(key, x, kind, order))


def bare(x: Column, by: Column | None = None, largest: bool = True, tie: Column | None = None) -> Column:
    """A column that is not grouped: the value in the row of MAX(by) or MIN(by); without by, any row's."""
    if by is None:
        return F.any_value(x)
    key = by if tie is None else F.struct(by, lit(tie))
    return (F.max_by if largest else F.min_by)(x, key)
