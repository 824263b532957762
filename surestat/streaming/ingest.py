"""Incremental runs: new files since the last one are processed once, with a checkpoint, and the query then ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def available_now(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, source_format: str = "parquet") -> None:
    """Appends transform(new rows) to sink, a Parquet table; a rerun takes only files that came since."""
    rows = spark.readStream.schema(schema).format(source_format).load(source)
    query = transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
