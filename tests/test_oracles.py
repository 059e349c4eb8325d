"""Every registered query against its SQL over the smallest tables; those without SQL must run."""

from __future__ import annotations

import math

import pytest

from docweave.plans import catalog

from .conftest import SMALL

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        sql = duck.sql(ORACLES[name])
        assert sorted(sql.columns) == sorted(df.columns)
        assert got == rows(sql.columns, sql.fetchall())
    else:
        assert df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
