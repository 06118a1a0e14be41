"""The registry, and every core query against its SQL on the smallest tables."""

import decimal
import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators.ranking import numbered
from gridloom.plans import ledger, problems

DATA = "/root/testdata/sf0.001"
CORE = {**ledger.ORACLES, **problems.ORACLES}


def test_registry():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert {"p1", "p2", "p3", "p5"} <= {q.split("_")[0] for q in queries}
    assert all(f.__doc__ or name in ledger.QUERIES for name, f in queries.items())


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, (int, float, decimal.Decimal)) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(CORE[name])
    wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    assert rows(df.columns, df.collect()) == wanted


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 500).alias("v"), F.col("id").alias("place0"))
    got = numbered(df, F.desc("v"), F.col("place0")).collect()
    want = sorted(((-(i * 7919 % 500), i) for i in range(1000)))
    assert {(r["v"], r["place0"]): r["place"] for r in got} == {(-v, i): k + 1 for k, (v, i) in enumerate(want)}
    assert numbered(df.limit(0), F.col("v")).count() == 0
