"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quernstone.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    columns = sorted(got.columns)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r)) for r in want.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in columns])
    assert sorted(map(key, rows)) == sorted(map(key, want))
