"""Every query of the library that has SQL equals it at sf0.001, and every other one runs."""

import math
import os

import duckdb
import pytest

from duolex.plans import corpus_queries, entity_queries, relational_queries, rule_queries, scalar_queries, scope_queries, text_queries, vector_queries  # noqa: F401
from duolex.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(([cell(r[k]) for k in order] for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), columns)
    else:
        assert df.columns
