"""Folders of immutable tables with a manifest, written anew for every change and opened again from the folder alone.

A change writes new files first and then the next manifest; a reader takes the
newest manifest, so it sees all of a change or nothing.  A writer that loses
the race to a manifest raises, and what it wrote is ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few file operations that a manifest needs, on the file system of the folder."""

    def __init__(self, spark, folder: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.hadoop.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, p: str, text: str) -> None:
        """Write a file that must not exist yet; it appears whole or not at all."""
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(tmp), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(p) or not self.fs.rename(self.path(tmp), self.path(p)):
            self.fs.delete(self.path(tmp), False)
            raise RuntimeError(f"another writer made {p}")

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength()

    def state(self, p: str) -> tuple:
        """Path, size and time of change of the files at `p`, which change when they do."""
        return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.path(p))))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class Manifest:
    """`folder`/manifest/<version>.json."""

    def __init__(self, files: Files, folder: str, first: dict):
        self.files, self.folder, self.first = files, f"{folder}/manifest", first

    def newest(self) -> dict:
        versions = sorted(n for n in self.files.names(self.folder) if n.endswith(".json"))
        return json.loads(self.files.read(f"{self.folder}/{versions[-1]}")) if versions else {"version": 0, **self.first}

    def commit(self, state: dict, **changes) -> None:
        """The next version after `state`; raises if another writer made it."""
        new = {**state, **changes, "version": state["version"] + 1}
        self.files.create(f"{self.folder}/{new['version']:09d}.json", json.dumps(new))


class Buckets:
    """A table in `folder`, in buckets by a hash of column `by`; changes write only the buckets they touch.

    A folder without a manifest reads as the empty table.  A batch that is in
    already is left out, so a repeated attempt does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, by: str, buckets: int = 16):
        self.spark, self.folder, self.schema, self.by = spark, folder, schema, by
        self.files = Files(spark, folder)
        self.manifest = Manifest(self.files, folder, {"tables": [], "batches": [], "buckets": buckets})
        self.buckets = self.manifest.newest()["buckets"]

    def bucket(self, value: Column | str) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def of(self, values: list) -> list[int]:
        """Buckets of a few values."""
        kind = self.schema[self.by].dataType
        rows = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)])).select(self.bucket("v")).collect() if values else []
        return sorted({r[0] for r in rows})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; other buckets aren't even listed."""
        paths = [p for p, b in self.manifest.newest()["tables"] if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> list:
        path = f"{self.folder}/data/t{uuid.uuid4().hex}"
        rows = df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields))
        # rows of a bucket meet, so a change makes few files; adaptive execution splits large buckets and joins small ones
        rows.withColumn("_b", self.bucket(self.by)).hint("rebalance", "_b").write.partitionBy("_b").parquet(path)
        return [[f"{path}/{n}", int(n[3:])] for n in self.files.names(path) if n.startswith("_b=")]

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        state = self.manifest.newest()
        batch = batch or uuid.uuid4().hex
        if batch not in state["batches"]:
            made = self._write(df)
            self.manifest.commit(state, tables=[*state["tables"], *made], batches=[*state["batches"], batch])

    def rewrite(self, buckets: list[int], change) -> None:
        """Replace the rows of some buckets by `change(rows)`, in one version."""
        state = self.manifest.newest()
        made = self._write(change(self.read(buckets)))
        self.manifest.commit(state, tables=[*(e for e in state["tables"] if e[1] not in buckets), *made])

    def compact(self, most: int = 8) -> list[int]:
        """Write buckets of more than `most` parts anew as one; the buckets that were due."""
        found = [b for _, b in self.manifest.newest()["tables"]]
        due = sorted({b for b in found if found.count(b) > most})
        if due:
            self.rewrite(due, lambda rows: rows)
        return due

    def vacuum(self) -> None:
        """Delete tables that the newest manifest doesn't name; no reader or writer may be at work on them."""
        used = {p.rsplit("/", 2)[1] for p, _ in self.manifest.newest()["tables"]}
        for name in self.files.names(f"{self.folder}/data"):
            if name not in used:
                self.files.delete(f"{self.folder}/data/{name}")
