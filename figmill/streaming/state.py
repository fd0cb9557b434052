"""Incremental runs as streams: new rows only, running counts, and the state of seen keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from figmill.operators.joins import unseen


def read(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(stream: DataFrame, time: str, keys: list[str], length: str, late: str, value: str) -> DataFrame:
    """Counts and sums of event-time windows; rows later than ``late`` are dropped once their window is final."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def first_of_each(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def into_state(stream: DataFrame, key: str, state_path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append keys not yet in the state table, batch after batch; ``each`` gets the new rows of a batch.

    Each batch writes a folder named by its number, so that a batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(fs_path):
            seen = spark.read.schema(rows.select(key).schema.add("batch", "long")).parquet(state_path).where(F.col("batch") != number)
            rows = unseen(rows, seen, key)
        if each:
            each(rows, number)
        rows.select(key).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
