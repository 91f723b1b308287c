"""An extension: reports on files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritile.plans import engine
from veritile.sources.sniff import format_of

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(image_id, format, content) of new files, a bounded number in each batch."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).load(folder)
    return raw.select(F.col("path").alias("image_id"), format_of(F.col("content")).alias("format"), "content")


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str, config: dict | None = None, only: list[str] | None = None):
    """Starts a query that appends reports as Parquet; each batch is scored like a batch of files."""

    def each(batch: DataFrame, number: int) -> None:
        engine.reports(engine.findings(batch, config, only)).write.mode("append").parquet(sink)

    return arriving(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
