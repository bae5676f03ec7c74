"""Keyed tables that micro-batches change together.

A batch writes the rows it changed in each table to new folders, then one marker file that names
all folders in use. Readers go by the newest marker, so they see all tables of a batch or none, and
files that a lost attempt left behind are never read. Now and then a batch writes whole tables;
folders that neither of the last two such states needs are removed.

Rows lie in buckets by the hash of some columns: a batch that gives the keys it touches reads their
buckets only. Take more buckets for larger tables; a bucket itself is written by as many tasks as
its size asks for.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = -1
_LOG = "_commits"


@dataclass(frozen=True)
class Table:
    """Rows with equal ``keys`` are replaced together; ``by`` are the columns among the keys that
    readers look rows up by. Keys are not NULL."""

    schema: T.StructType
    keys: list[str]
    by: list[str] = field(default_factory=list)

    @property
    def spread(self) -> list[str]:
        return self.by or self.keys


@dataclass(frozen=True)
class Change:
    """New rows of some keys. ``keys`` names the keys to replace where some of them have no rows
    any more; by default those of the rows."""

    rows: DataFrame
    keys: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table],
                 full_every: int = 20, buckets: int = 16):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.full_every, self.buckets = full_every, buckets

    # ---- the marker files, by the file system of the path

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._file(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def batches(self) -> list[int]:
        """Numbers of the batches whose markers are there, the seed being the first."""
        return sorted(int(n.split(".")[0]) for n in self._names(_LOG) if n.endswith(".json"))

    def committed(self, batch: int) -> bool:
        fs, path = self._file(_LOG, f"{batch:012d}.json")
        return fs.exists(path)

    def _marker(self, batch: int) -> dict:
        fs, path = self._file(_LOG, f"{batch:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self, before: int | None = None) -> dict:
        """What the newest marker of an earlier batch says; no folders without one."""
        known = [b for b in self.batches() if before is None or b < before]
        return self._marker(known[-1]) if known else {
            "batch": SEED - 1, "full": SEED - 1, "tables": {name: [] for name in self.tables}}

    def _publish(self, state: dict) -> None:
        fs, path = self._file(_LOG, f"{state['batch']:012d}.json")
        _, draft = self._file(_LOG, f".{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not fs.rename(draft, path):
            raise RuntimeError(f"batch {state['batch']} was published by somebody else")

    # ---- reading

    def _bucket(self, table: Table) -> Column:
        return F.pmod(F.xxhash64(*table.spread), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        layout = T.StructType([*self.tables[name].schema.fields,
                               T.StructField("_gone", T.BooleanType()),
                               T.StructField("_batch", T.LongType()),
                               T.StructField("_folder", T.StringType()),
                               T.StructField("_bucket", T.IntegerType())])
        base = f"{self.path}/{name}"
        return (self.spark.read.schema(layout).option("basePath", base)
                .parquet(*[f"{base}/_folder={f}" for f in folders]))

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].schema)

    def current(self, name: str, before: int | None = None,
                keys: DataFrame | None = None) -> DataFrame:
        """A table as of the batches before this one, of all by default; with ``keys``, values of
        the columns it is looked up by, only the rows that have them."""
        table, folders = self.tables[name], self._state(before)["tables"][name]
        if not folders:
            return self.empty(name)
        rows = self._read(name, folders)
        if keys is not None:
            # Equal buckets let the scan leave out partitions that hold none of the keys.
            wanted = keys.select(*table.spread).withColumn("_bucket", self._bucket(table))
            rows = rows.join(wanted, ["_bucket", *table.spread], "left_semi")
        if len(folders) < 2:
            return rows.filter("not _gone").select(*table.schema.names)
        # Only what changed since the whole table is grouped.
        changed = rows.filter(F.col("_folder") != folders[0])
        newest = changed.groupBy(*table.keys).agg(F.max("_batch").alias("_newest"))
        kept = rows.filter(F.col("_folder") == folders[0]).join(
            newest.select(*table.keys), table.keys, "left_anti")
        newer = changed.join(newest, table.keys).filter("_batch = _newest").drop("_newest")
        return newer.unionByName(kept.select(*newer.columns)).filter("not _gone").select(
            *table.schema.names)

    # ---- writing

    def seed(self, **tables: DataFrame) -> None:
        """The tables before the first batch; those not given are empty."""
        self._commit(SEED, {n: Change(df) for n, df in tables.items()}, full=True)

    def commit(self, batch: int, changes: dict[str, Change | DataFrame]) -> None:
        """Change tables and publish all of it at once. A batch that is published already changes
        nothing."""
        if self.committed(batch):
            return
        given = {n: c if isinstance(c, Change) else Change(c) for n, c in changes.items()}
        self._commit(batch, given, full=batch > 0 and batch % self.full_every == 0)

    def _commit(self, batch: int, changes: dict[str, Change], full: bool) -> None:
        state = self._state(batch)
        tables = {name: list(state["tables"][name]) for name in self.tables}
        for name, table in self.tables.items():
            change = changes.get(name)
            if full and (change is not None or tables[name]):
                if change is None:
                    rows = self.current(name, batch)
                else:
                    rows = change.rows.select(*table.schema.names)
                    if tables[name]:
                        replaced = (change.rows if change.keys is None else change.keys).select(
                            *table.keys)
                        rows = self.current(name, batch).join(
                            replaced, table.keys, "left_anti").unionByName(rows)
                tables[name] = [self._write(name, rows.withColumn("_gone", F.lit(False)), batch)]
            elif not full and change is not None:
                rows = change.rows.select(*table.schema.names).withColumn("_gone", F.lit(False))
                if change.keys is not None:
                    empty = change.keys.select(*table.keys).distinct().join(
                        change.rows.select(*table.keys), table.keys, "left_anti")
                    rows = rows.unionByName(empty.withColumn("_gone", F.lit(True)),
                                            allowMissingColumns=True)
                tables[name].append(self._write(name, rows, batch))
        self._publish({"batch": batch, "full": batch if full else state["full"], "tables": tables})
        if full:
            self._remove_old()

    def _write(self, name: str, rows: DataFrame, batch: int) -> str:
        table = self.tables[name]
        folder = f"{batch + 1:012d}-{uuid.uuid4().hex}"
        (rows.withColumn("_batch", F.lit(batch).cast("bigint"))
         .withColumn("_bucket", self._bucket(table)).hint("rebalance", "_bucket")
         .write.partitionBy("_bucket").parquet(f"{self.path}/{name}/_folder={folder}"))
        return folder

    def _remove_old(self) -> None:
        """Remove markers and folders that neither of the last two whole states needs, those of
        attempts that were never published among them."""
        states = [self._marker(b) for b in self.batches()]
        fulls = sorted({s["full"] for s in states})
        kept = [s for s in states if s["batch"] >= fulls[-2:][0]]
        newest = states[-1]["batch"]
        used = {name: {f for s in kept for f in s["tables"][name]} for name in self.tables}
        for s in states:
            if s["batch"] < kept[0]["batch"]:
                fs, path = self._file(_LOG, f"{s['batch']:012d}.json")
                fs.delete(path, False)
        for name in self.tables:
            for found in self._names(name):
                folder = found.split("=", 1)[-1]
                if folder not in used[name] and int(folder.split("-")[0]) - 1 <= newest:
                    fs, path = self._file(name, found)
                    fs.delete(path, True)


class StateTable:
    """A store of one table, unique by key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType,
                 full_every: int = 20):
        self.store = Store(spark, path, {"rows": Table(schema, keys)}, full_every)

    def seed(self, df: DataFrame) -> None:
        """The table before the first batch, empty unless given here."""
        self.store.seed(rows=df)

    def current(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        return self.store.current("rows", before, keys)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """Store the rows this batch inserted or changed, unique by key."""
        self.store.commit(batch, {"rows": changed})
