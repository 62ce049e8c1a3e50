"""Incremental processing of arriving files with a checkpointed file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], target: str,
    checkpoint: str, fmt: str = "parquet", partition: str | None = None, **options,
) -> None:
    """Process the files that arrived since the last call, then stop.

    The stream's checkpoint remembers what was read, so each file is handled once; the Parquet sink
    commits per batch and a restarted run repeats no output.
    """
    arrived = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    writer = transform(arrived).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    writer.trigger(availableNow=True).start(target).awaitTermination()


def process_new_batches(
    spark: SparkSession, source: str, schema: StructType, handle: Callable[[DataFrame, int], None], checkpoint: str,
    fmt: str = "parquet", **options,
) -> None:
    """The same with a batch function, for operators that need whole tables (windows, joins)."""
    arrived = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    arrived.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
