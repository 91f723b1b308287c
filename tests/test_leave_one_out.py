"""The median of the others where values occur more than once."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritile.operators import matching
from veritile.plans.registry import ORACLE_SQL, QUERIES


def test_copies_equal_sql(spark, tmp_path):
    """Suppliers that are there three times with shifted keys, and a nation of one supplier."""
    one = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet")
    three = one.crossJoin(spark.range(3)).withColumn("s_suppkey", F.col("s_suppkey") + 100 * F.col("id")).drop("id")
    alone = one.limit(1).withColumns({"s_suppkey": F.lit(999).cast("long"), "s_nationkey": F.lit(77).cast(dict(one.dtypes)["s_nationkey"])})
    three.unionByName(alone).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r[0]: r[1] for r in QUERIES["loo_median"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = dict(db.sql(ORACLE_SQL["loo_median"]).fetchall())
    assert got.keys() == want.keys() and len(got) == 301 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("keep_equal", [True, False])
def test_equals_brute_force(spark, keep_equal):
    r = np.random.default_rng(3)
    rows = [(None if k % 9 == 0 else int(k % 9), i, float(r.integers(0, 6)) if i % 13 else None) for i, k in enumerate(r.integers(0, 40, 150))] + [(100, 1000, 5.0), (101, 1001, None)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {q["i"]: q["loo"] for q in matching.leave_one_out_median(df, "k", "v", "i", keep_equal).collect()}
    for k, i, v in rows:
        others = [w for q, j, w in rows if q == k and j != i and w is not None and (keep_equal or w != v)]
        assert got[i] == (None if v is None else np.median(others) if others else v), (k, i, v)
    assert len(got) == len(rows)
