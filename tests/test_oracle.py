"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from trackframe.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = {"m1_train_perceptron", "m1_train_forest", "m1_train_one_vs_rest", "m5_evaluate_models", "e1_detections_to_tracks"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def text(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    ours = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in want.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
