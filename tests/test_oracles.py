"""Every registered query of the core against its SQL, over whole tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from morphmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, small, name):
    got = catalog.queries()[name](spark, small)
    columns = sorted(got.columns)
    rows = Counter(repr(tuple(r)) for r in got.select(*columns).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_oracles_are_of_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
