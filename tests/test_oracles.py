"""Every plan with an oracle gives the oracle's rows."""

import os

import duckdb
import pytest

from docgrain.plans import registry
from docgrain.plans._registry import CASES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fold = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr([fold(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, sf, name):
    df = PLANS[name](spark, sf)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, cursor.fetchall())


def test_each_plan_has_an_oracle_or_a_test():
    here = os.path.dirname(os.path.abspath(__file__))
    tested = "".join(open(os.path.join(here, f)).read() for f in os.listdir(here) if f.endswith(".py"))
    assert [n for n in PLANS if n not in SQL and n not in tested] == []


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, con, sf, name):
    """Given rows and what is expected of them."""
    plan, sql = CASES[name]
    df = plan(spark, sf)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, cursor.fetchall())
