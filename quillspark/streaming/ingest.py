"""Incremental ingest: a file stream, once through everything new, upserted batch by batch.

The stream's checkpoint takes the place of a log of what is done; row-local operators apply unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from quillspark.operators.ingest import latest_per_key
from quillspark.runtime import scratch_file


def ingest_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema=None, transform: Callable[[DataFrame], DataFrame] | None = None, format: str = "parquet"
) -> None:
    """Appends every new file of ``source`` to ``target``, exactly once per checkpoint, then returns."""
    reader = spark.readStream.format(format).schema(schema or spark.read.format(format).load(source).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(path):
        # A stream reads folders: a single file is the only match in its own.
        source, reader = path.getParent().toString(), reader.option("pathGlobFilter", path.getName())
    rows = reader.load(source)
    rows = transform(rows) if transform else rows
    write = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    write.awaitTermination()


def ingest_once(spark: SparkSession, source: str, key: str, newest_first: list[Column]) -> DataFrame:
    """The latest row per key of all files of ``source``, taken in by one stream run into scratch tables."""
    place = scratch_file(spark, "stream")
    ingest_stream(spark, source, f"{place}/table", f"{place}/checkpoint")
    return latest_per_key(spark.read.parquet(f"{place}/table"), [key], newest_first)
