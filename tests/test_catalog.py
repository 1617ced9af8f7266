"""Queries against their SQL on the driver's smallest tables."""

import duckdb
import pytest

from granary.plans import catalog, checks, journals, more, results  # noqa: F401

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
NAMES = sorted(catalog.SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(rows, columns):
    text = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert shown(got.collect(), columns) == shown([dict(zip(names, r, strict=True)) for r in found.fetchall()], columns)


def test_names_of_sql():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
