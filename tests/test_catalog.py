"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import math
import os

import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(row):
    return tuple("NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    assert sorted(plain(r) for r in got.select(*cols).collect()) == sorted(plain(r) for r in duck.sql(f"select {names} from ({catalog.ORACLES[name]})").fetchall())
