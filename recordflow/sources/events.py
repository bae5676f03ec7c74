"""Event source: pushed events as a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_batch: int | None = None, **options) -> DataFrame:
    """Stream of new files below ``path`` (``fmt`` 'parquet' or 'json'), or of a Kafka topic
    (``fmt`` 'kafka' with its options; ``path`` is then the topic and values stay raw text)."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return (reader.option("subscribe", path).load()
                .selectExpr("CAST(value AS STRING) AS body", "timestamp AS arrived_on"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(schema).load(path)
