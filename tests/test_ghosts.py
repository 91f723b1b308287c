"""Ghost curves: nulls and labels, and kernels that hold some blocks at a time."""

import numpy as np
from pyspark.sql import functions as F

from veritile.functions import kernels
from veritile.operators import dct
from veritile.plans.registry import QUERIES


def test_curve_and_nulls(spark):
    r = np.random.default_rng(4)
    b = r.integers(0, 256, (6, 8, 8)).astype(float)
    rows = [(i, None if i == 2 else b[i].ravel().tolist(), None if i == 4 else i) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, block array<double>, label int").coalesce(1)
    first = F.when(F.col("label") < 3, 60).otherwise(80)
    got = df.select("i", dct.ghost_curve(F.col("block"), [50, 90], first).alias("c"), dct.recompressed(F.col("block"), 70).alias("r")).collect()
    for row in got:
        if row["i"] == 2:
            assert row["c"] is None and row["r"] is None
            continue
        x = b[row["i"]][None]
        once = kernels.recompress_blocks(x, 60 if row["i"] < 3 else 80)
        assert np.allclose(row["c"], [((once - kernels.recompress_blocks(once, q)) ** 2).mean() for q in (50, 90)])
        assert (np.array(row["r"]) == kernels.recompress_blocks(x, 70).ravel()).all()


def test_kernels_hold_some_blocks(spark):
    """A batch from Spark has up to 10,000 rows, and its copies in the kernels filled a worker."""
    import pyarrow as pa

    rows = pa.array([[float(k)] * 64 for k in range(2500)], pa.list_(pa.float64()))
    assert [(lo, len(x)) for lo, x in dct._chunks(rows)] == [(0, 1024), (1024, 1024), (2048, 452)]
    plan = QUERIES["ghost_block_diff"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
