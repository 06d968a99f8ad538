"""Window frames and exclusions on the seven-row table of peers, worked out by plain loops."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import aggregates as agg
from ferrule.operators import windows as win

ROWS = [(1, 1, 10, 1.0), (2, 1, 10, 2.0), (3, 1, 20, 3.0), (4, 1, 30, 4.0), (5, 1, 30, None), (6, 2, 5, 6.0), (7, 2, None, 7.0)]


@pytest.fixture
def peers(spark):
    return spark.createDataFrame(ROWS, "id long, g int, k int, v double")


def expected(unit, low, high, exclude, function):
    out = {}
    for row in ROWS:
        part = sorted((r for r in ROWS if r[1] == row[1]), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        keys = sorted({(r[2] is not None, r[2] or 0) for r in part})
        d = lambda r: keys.index((r[2] is not None, r[2] or 0))
        place = part.index if unit == "rows" else d
        inside = [r for r in part if (low is None or place(r) - place(row) >= low) and (high is None or place(r) - place(row) <= high)]
        kept = [r for r in inside if exclude is None or {"current row": r[0] != row[0], "group": d(r) != d(row), "ties": d(r) != d(row) or r[0] == row[0]}[exclude]]
        values = [r[3] for r in kept if r[3] is not None]
        out[row[0]] = {"count": len(values), "sum": sum(values) if values else None, "max": max(values, default=None), "min": min(values, default=None), "avg": sum(values) / len(values) if values else None}[function]
    return out


@pytest.mark.parametrize("exclude", [None, "current row", "group", "ties"])
@pytest.mark.parametrize("unit, low, high", [("groups", -1, 1), ("groups", 0, None), ("groups", None, -1), ("rows", -1, 1), ("rows", 1, 2), ("rows", -1, None), ("rows", 1, None), ("groups", 1, None), ("groups", -1, None)])
def test_frames(peers, unit, low, high, exclude):
    order = (F.col("k"), F.col("id")) if unit == "rows" else (F.col("k"),)
    s = win.Spec(("g",), order, unit, low, high, exclude, ("k",))
    if unit == "rows" and exclude in ("group", "ties"):
        pytest.skip("peers of a total order are single rows")
    for f in (F.sum, F.count, F.max, F.min, F.avg):
        got = {r.id: r.x for r in win.over(peers, "x", f, F.col("v"), s).collect()}
        assert got == expected(unit, low, high, exclude, f.__name__)


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
def test_excluded_sum(peers, exclude):
    s = win.Spec(("g",), (F.col("k"),), "groups", None, 0, exclude, ("k",))
    assert {r.id: r.x for r in win.excluded_sum(peers, "x", F.col("v"), s).collect()} == expected("groups", None, 0, exclude, "sum")


def test_named_windows_cannot_be_overridden():
    base = win.Spec(("g",), (F.lit(1),))
    with pytest.raises(ValueError):
        base.extend((F.lit(2),))


def test_aggregates(peers):
    v, k = F.col("v"), F.col("k")
    row = peers.agg(agg.total(v).alias("t"), agg.group_concat(k, order=[F.col("id")]).alias("g"), agg.json_group_array(v, order=[F.col("id")]).alias("j"), agg.decimal_sum(v).alias("d"), agg.percentile(v, 50).alias("p"), agg.bare(F.col("id"), v).alias("b"), agg.json_group_object(F.col("g").cast("string"), k, order=[F.col("id")]).alias("o")).first()
    assert row[:] == (23.0, "10,10,20,30,30,5", "[1.0,2.0,3.0,4.0,null,6.0,7.0]", "23", 3.5, 7, '{"1":10,"1":10,"1":20,"1":30,"1":30,"2":5,"2":null}')
    none = peers.limit(0).agg(agg.total(v).alias("t"), agg.group_concat(k).alias("g"), agg.json_group_array(v).alias("j"), agg.avg(v, True).alias("a")).first()
    assert none[:] == (0.0, None, "[]", None)
    with pytest.raises(ValueError):
        agg.group_concat(k, ";", distinct=True)
