"""What the operators of this subpackage share: session set-up, words and hashes as columns."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.session import materialize, tune

# ASCII white space (space, tab, line feed, vertical tab, form feed, return).
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of Arrow data handed to a Python worker at a time; with it the memory of a worker is
#: bounded by its largest single text.
BATCH_BYTES = "4m"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on; Python workers import the library by its path."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # Steps are written down by `stored`: what a step shuffled goes when it has ended, not when the
    # driver happens to collect garbage. With many partitions that is a file each, hundreds of times.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, paths]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table of a folder."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, '' where it is NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def fold(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def crc_class(doc_id: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later reads survive lost executors."""
    return materialize(df, label)


def give_back() -> None:
    """In a Python worker: memory that is free again goes back to the system. Workers outlive their
    tasks, and an executor is charged with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in held:
            name += "_"
        out.append(f"_{name}")
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
