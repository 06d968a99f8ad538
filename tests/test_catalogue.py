"""Every registered query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from ferrule import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data) if all(normal(x) is not None for r in data for x in r) else sorted((tuple(normal(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    assert name in catalogue.ORACLES, "every query has an oracle"
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_order_nulls_with_a_null_key(spark, sf, tmp_path):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE customer AS SELECT * REPLACE (CASE WHEN c_custkey <> 5 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey NOT IN (5, 7) THEN c_acctbal END AS c_acctbal) FROM read_parquet('{sf}/customer.parquet')")
    c.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT PARQUET)")
    df = catalogue.QUERIES["order_nulls"](spark, str(tmp_path))
    want = c.execute(catalogue.ORACLES["order_nulls"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
