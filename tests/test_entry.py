"""The driver contract: names, schemas, and the queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_point
from parchment.plans.queries import ORACLE, QUERIES


def test_entry(spark, sf):
    assert entry_point.entry(spark).columns == ["project", "samples", "relevant", "irrelevant", "blocked", "fused", "status"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda data: sorted(repr(tuple(map(plain, r))) for r in data)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows(got.select(*cols).collect()) == rows(con.sql(f"select {quoted} from want").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
