"""Every catalogue query against DuckDB on the smallest tables."""

import inspect
import math

import duckdb
import pytest

from cohortlake.plans import catalogue, models, standards  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    mine = sorted("|".join(text(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted("|".join(text(r[i]) for i in at) for r in relation.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_bootstrap_stability_draws_a_hundred_times(spark, monkeypatch):
    asked = []
    whole = catalogue.C.bootstrap_stability
    monkeypatch.setattr(catalogue.C, "bootstrap_stability", lambda *a, **b: asked.append(len(a) < 4 and not b) or whole(*a, **b))
    rows = catalogue.QUERIES["bootstrap_stability"](spark, DATA).collect()
    assert asked == [True] and rows
    assert inspect.signature(whole).parameters["iterations"].default == 100
