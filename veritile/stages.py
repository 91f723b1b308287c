"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if all run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veritile-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Deletes the shuffle files of a query when it ends.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a reread and not a recomputation, and later jobs read only the columns they need.  What
    was shuffled for the table is deleted when it is written; ``discard`` deletes the table.  ``batch_rows``: the most rows
    that go to a Python worker at once, for wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritile-{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    if _open:
        _open[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these; nothing made from them can be read any more."""
    for df in tables:
        if (name := _written.pop(df, None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_open: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``materialize`` writes inside the block is deleted at its end, but for what the given function was called with."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        discard(*(df for df in made if not any(df is k for k in kept)))
        if _open:
            _open[-1].extend(df for df in kept if any(df is m for m in made))
