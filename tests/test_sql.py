"""Every query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from estimark import catalog

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if value is not None else None


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert ours == theirs
