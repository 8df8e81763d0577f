"""Every query with an oracle gives the same rows as the other engine's SQL."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

from symloom import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(name, spark, sf, duck):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ran = duck.execute(Q.ORACLES[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in place) for r in ran.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(name, spark, sf):
    assert Q.QUERIES[name](spark, sf).count() > 0
