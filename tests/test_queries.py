"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from facetry.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def ordered(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = sorted(c[0] for c in found.description)
    names = [c[0] for c in found.description]
    expected = [dict(zip(names, r)) for r in found.fetchall()]
    assert columns == sorted(df.columns)
    assert ordered(rows, columns) == ordered(expected, columns)
