"""Every registered query of the image operators equals its SQL."""

import duckdb
import numpy as np
import pytest

from veritile.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    order = sorted(cols, key=lambda c: (got[c].dtype.kind == "f", c))
    as_text = lambda df: df[cols].sort_values(order, key=lambda s: s.astype(str) if s.dtype.kind == "O" else s).reset_index(drop=True)
    a, b = as_text(got), as_text(want.astype({c: got[c].dtype for c in cols if got[c].dtype.kind in "iu" and not want[c].isna().any()}))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_registry():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)


def test_a_region_outside_fails(spark):
    from veritile.operators import planes
    from veritile.plans.queries import canvas

    px = canvas(spark, "/root/testdata/sf0.001")
    with pytest.raises(Exception, match="leaves the image"):
        planes.crop(px, 150, 8, 64, 24).count()
    with pytest.raises(ValueError):
        planes.crop(px, -1, 0, 4, 4)
