"""Every catalogue query agrees with its SQL."""

import os

import duckdb
import pytest

from shelfmark.plans import catalog, stored, streams

SIZES = "sf0.001", "sf0.01"
QUERIES, ORACLES = catalog.QUERIES | stored.QUERIES | streams.QUERIES, catalog.ORACLES | stored.ORACLES | streams.ORACLES


def plain(frame, columns):
    def value(v):
        if v is None or v != v:
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(map(tuple, frame[columns].map(value).values.tolist()))


def cases():
    """Streams and stored tables, whose jobs are many, at the smallest size only."""
    return [(name, size) for name in QUERIES for size in SIZES[: 2 if name in catalog.QUERIES else 1]]


@pytest.mark.parametrize(("name", "size"), cases())
def test_agrees_with_sql(spark, name, size):
    con, folder = duckdb.connect(), f"/root/testdata/{size}"
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert plain(want, columns) == plain(got, columns)
