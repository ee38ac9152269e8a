"""Every query with SQL gives the rows that the SQL gives, on the smallest tables."""

import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from storyloom.plans import evidence, facts, names, reports, rules  # noqa: F401
from storyloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == want
