"""Tables between steps: what is kept, what is deleted, and where they go."""

import os

import pytest
from pyspark.sql import functions as F

from veritile import stages


def tables(spark):
    return {n for n in os.listdir(stages.shared_dir(spark).removeprefix("file:")) if n.startswith("veritile-")}


def test_tables_are_deleted(spark):
    before = tables(spark)
    with stages.temporary() as keep:
        a = stages.materialize(spark.range(10), "a")
        b = keep(stages.materialize(a.withColumn("x", F.col("id") + 1), "b"))
        assert len(tables(spark) - before) == 2
    assert len(tables(spark) - before) == 1 and b.agg(F.sum("x")).first()[0] == 55
    stages.discard(b, spark.range(3))
    assert tables(spark) == before


def test_settings_are_as_before(spark):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception):
        stages.materialize(spark.range(4).select(F.raise_error(F.lit("no"))), "c", 7)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
