"""Text-format sources and sinks, messy-sheet ingest, and the artifact manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions.text import clean

CORRUPT = "_corrupt_record"
_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
         "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_CSV = {"header": "true", "quote": '"', "escape": '"', **_TIME,
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# File extension -> (artifact type, media type).
ARTIFACT_KINDS = {
    "zip": ("trace", "application/zip"),
    "png": ("screenshot", "image/png"),
    "jpg": ("screenshot", "image/jpeg"),
    "webm": ("video", "video/webm"),
    "mp4": ("video", "video/mp4"),
    "out": ("stdout", "text/plain"),
    "err": ("stderr", "text/plain"),
    "html": ("report", "text/html"),
    "pdf": ("report", "application/pdf"),
}

# An empty cell is NULL and a quoted empty one is '': no cell text may stand for NULL itself.
_CSV_READ = {**_CSV, "nullValue": "\x00"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "fail",
             multi_line: bool = True) -> DataFrame:
    """CSV with header. ``fail`` rejects the input at its first bad row; ``quarantine`` keeps
    bad rows, their raw text in ``_corrupt_record`` (see :func:`split_corrupt`).

    With ``multi_line`` a file is one task, since a quoted cell may hold line breaks; the
    writer below produces many files. Turn it off for single-line data to split large files.
    """
    if on_error not in ("fail", "quarantine"):
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    cells = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields),
                          T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.options(**_CSV_READ).option("multiLine", multi_line).schema(cells)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("columnPruning", "false").csv(path))
    # Types are checked here and not by the reader, which skips columns nobody selects.
    unread = F.col(CORRUPT).isNotNull()
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            unread = unread | (F.nullif(F.col(f.name), F.lit("")).isNotNull()
                               & F.col(f.name).try_cast(f.dataType).isNull())
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*schema.names)))
    marked = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name)
                          for f in schema.fields], F.when(unread, line).alias(CORRUPT))
    if on_error == "quarantine":
        return marked
    stop = F.raise_error(F.concat(F.lit("unreadable row: "), F.col(CORRUPT))).cast("boolean")
    return marked.filter(F.when(F.col(CORRUPT).isNotNull(), stop).otherwise(True)).drop(CORRUPT)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) of a ``quarantine`` read."""
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.filter(F.col(CORRUPT).isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**_CSV).mode("errorifexists").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.options(**_TIME, ignoreNullFields="false").mode("errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_TIME, mode="FAILFAST").json(path)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows") -> None:
    (df.write.format("xml").options(**_TIME, rowTag=row_tag, rootTag=root_tag)
     .mode("errorifexists").save(path))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return (spark.read.format("xml").schema(schema)
            .options(**_TIME, rowTag=row_tag, ignoreSurroundingSpaces="false").load(path))


def ungroup_digits(c) -> Column:
    """Drop no-break spaces that stand between digits: '59\\u00a0000' -> '59000'."""
    value = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(value, "(?<=[0-9])[\\u00a0\\u202f](?=[0-9])", "")


def ingest_messy(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a messy sheet saved as CSV: text cells are stripped, empty cells become NULL,
    number cells lose their digit grouping, unreadable numbers become NULL and rows without
    any cell are dropped. Inner line breaks, quotes, tabs and emoji stay as they are."""
    raw = read_csv(spark, path, T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schema.fields]))
    cells = []
    for field in schema.fields:
        cell = F.nullif(clean(field.name), F.lit(""))
        if not isinstance(field.dataType, T.StringType):
            cell = ungroup_digits(cell).try_cast(field.dataType)
        cells.append(cell.alias(field.name))
    return raw.select(*cells).dropna("all")


def artifact_columns(path, size, kinds: dict | None = None) -> dict[str, Column]:
    """Name, path, type, media type and size of a file, from columns with its path and size. The
    name is what follows the last slash, and what follows its last dot tells the type; a NULL
    size is 0."""
    path = F.col(path) if isinstance(path, str) else path
    size = F.col(size) if isinstance(size, str) else size
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    table = (kinds or ARTIFACT_KINDS).items()

    def pick(index: int, other: str) -> Column:
        return reduce(lambda rest, kind: F.when(ext == kind[0], kind[1][index]).otherwise(rest),
                      table, F.lit(other))

    return {"file_name": name, "file_path": path, "artifact_type": pick(0, "other"),
            "mime_type": pick(1, "application/octet-stream"),
            "size_bytes": F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))}


def artifact_manifest(spark: SparkSession, folder: str, kinds: dict | None = None) -> DataFrame:
    """One row per file below ``folder``: name, type, media type, size. Contents are not read;
    files without any content are not listed by the source."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", "length"))
    return files.select(*[c.alias(n) for n, c in artifact_columns("path", "length", kinds).items()])
