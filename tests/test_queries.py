"""Every core query against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from cartomill import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import os

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else repr(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = db.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.astype(object)) == rows(want.astype(object))
    else:
        assert len(got.columns)


def test_flagship(spark):
    got = queries.flagship(spark, SF).toPandas()
    assert len(got)
    assert (got.groupby("map_id").fraction.sum() - 1).abs().max() < 1e-9
