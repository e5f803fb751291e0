"""Every query that has SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from sparkloam import queries, queries_io  # noqa: F401

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def _row(r):
    return tuple(round(x, 7) if isinstance(x, float) and not math.isnan(x) else x for x in r)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, D)
    cur = db.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = cur.fetchall()
    assert sorted(map(_row, got.select(*names).collect()), key=str) == sorted(map(_row, want), key=str)
