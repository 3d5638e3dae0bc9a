"""Each query with SQL against DuckDB on the smallest tables, where these are there."""

import math
from pathlib import Path

import pytest

from rasterloom import catalog, catalog_lines  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0 if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(DATA))
    found = con.execute(catalog.SQL[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    columns = sorted(df.columns)
    assert columns == sorted(at)
    want = [[r[at[c]] for c in columns] for r in found.fetchall()]
    assert rows_of([[r[c] for c in columns] for r in df.collect()]) == rows_of(want)
