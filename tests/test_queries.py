"""Every query against its SQL in DuckDB at the smallest scale, and the shape of those that SQL cannot express."""

import datetime
import decimal

import duckdb
import pytest

from orrery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(catalog.SQL[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    assert sorted(at) == cols
    assert got == sorted(repr([plain(x[at[c]]) for c in cols]) for x in r.fetchall())


def test_sql_only_queries_have_no_python(spark, sf_dir):
    for name in ("wn01_rank_of_first_hit", "ts01_gaussian", "jn06_nearest_in_time", "mk01_mask_iou", "gr05_reachable"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["jn18_semi"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,300000" in plan and "ReadSchema: struct<c_custkey:bigint>" in plan
