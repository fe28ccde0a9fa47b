import os

import duckdb
import pytest

import __spark_entry__ as entry
from quantara import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return c


def rows_of(columns, rows):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in by) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, map(tuple, df.collect()))
    answer = duck.execute(queries.SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, answer.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-12, abs=1e-12) if all(isinstance(x, (int, float)) for x in w) else g == w


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark):
    plan = queries.QUERIES["limit_prefix"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(event_id,1000)" in plan
    plan = queries.QUERIES["batch_summary_stats"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
