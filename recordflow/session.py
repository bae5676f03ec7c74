"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Counts shuffled bytes after compression: keys and states take some 25 times that in a sort.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A repeated key in a JSON object: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot join keys: split the oversized partitions even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tune(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on; the number of partitions and the memory stay
    as the cluster set them. Python workers import the library by its path."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, paths]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordflow-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, used once. All paths of an application lie in one
    folder, to be removed when it has ended: until then a DataFrame may still read them."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/recordflow-{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, survives lost executors.
    With ``by``, a reader that asks for some values of these columns reads their folders only."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
