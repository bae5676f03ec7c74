"""Table scans with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recordflow.schemas import INPUT_DDL, schema_of


def scan(spark: SparkSession, folder: str, name: str,
         schema: T.StructType | None = None) -> DataFrame:
    """Read ``folder/name.parquet`` with its declared schema; nothing is inferred."""
    return spark.read.schema(schema or schema_of(name)).parquet(f"{folder}/{name}.parquet")


def scan_all(spark: SparkSession, folder: str, names=None) -> dict[str, DataFrame]:
    """Several tables by name; scans are lazy, so unused ones cost nothing."""
    return {name: scan(spark, folder, name) for name in (names or INPUT_DDL)}
