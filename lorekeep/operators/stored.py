"""The store and its keyword index on disk: writes, deletions, compaction and recovery as versions of tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.versions import Buckets, Files
from . import store as S
from .keywords import KeywordIndex


class Store:
    """Documents in buckets by namespace; a mutation writes the buckets of its namespaces anew.  A missing folder is an empty store."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.table = Buckets(spark, folder, S.DOCUMENT, "namespace", buckets)

    def documents(self, namespace: str | None = None) -> DataFrame:
        return self.table.read() if namespace is None else S.in_namespace(self.table.read(self.table.of([namespace])), namespace)

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        self.table.append(rows, batch)

    def _change(self, namespaces: list[str], change) -> None:
        self.table.rewrite(self.table.of(namespaces), change)

    def delete_key(self, namespace: str, id_: str) -> None:
        self._change([namespace], lambda rows: S.without_key(rows, namespace, id_))

    def delete_namespace(self, namespace: str) -> None:
        self._change([namespace], lambda rows: S.without_namespace(rows, namespace))

    def delete_matching(self, namespace: str, **filters) -> None:
        self._change([namespace], lambda rows: S.without_matching(rows, namespace, **filters))

    def delete_family(self, namespace: str, id_: str) -> None:
        self._change([namespace], lambda rows: S.without_family(rows, namespace, id_))

    def upsert(self, rows: DataFrame) -> None:
        """Replace the families of the rows' keys."""
        touched = sorted(r[0] for r in rows.select(self.table.bucket("namespace")).distinct().collect())  # at most one number a bucket
        self.table.rewrite(touched, lambda kept: S.upserted(kept, rows))

    def tidy(self, most_parts: int = 8, most_versions: int = 50) -> bool:
        """Compact and drop old tables where buckets have many parts or versions pile up; whether anything was due."""
        due = bool(self.table.compact(most_parts))
        if due or self.table.manifest.newest()["version"] % most_versions == 0:
            self.table.vacuum()
            return True
        return False


class DualStore:
    """A store and its keyword index kept in step by a ledger of writes under way."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store, self.index = Store(spark, f"{folder}/documents"), KeywordIndex(spark, f"{folder}/keywords")
        self.files, self.pending = Files(spark, folder), f"{folder}/pending"

    def write(self, rows: DataFrame, batch: str | None = None) -> None:
        """Store and index the rows; a batch that was under way is finished from what is stored, and one that is in is left out."""
        batch = batch or uuid.uuid4().hex
        if self.files.exists(f"{self.pending}/{batch}.json"):
            self.recover()
        if batch in self.store.table.manifest.newest()["batches"]:
            return
        self.files.create(f"{self.pending}/{batch}.json", json.dumps({"batch_id": batch, "status": "pending"}))
        self.store.append(rows, batch)
        self.index.add(rows, batch)
        self.files.delete(f"{self.pending}/{batch}.json")

    def delete(self, namespace: str, id_: str | None = None) -> None:
        """From the index first: a row without postings is found by no keyword, postings without a row would name nothing."""
        self.index.delete(namespace, None if id_ is None else [id_])
        if id_ is None:
            self.store.delete_namespace(namespace)
        else:
            self.store.delete_key(namespace, id_)

    def recover(self) -> dict[str, str]:
        """Finish or drop the writes that were under way: {batch: replayed or dropped}."""
        done = {}
        for name in self.files.names(self.pending):
            batch = json.loads(self.files.read(f"{self.pending}/{name}"))["batch_id"]
            stored = batch in self.store.table.manifest.newest()["batches"]
            if stored:  # its rows are the ones that the index lacks
                rows = self.store.documents()
                self.index.add(rows.join(self.index.rows.read().select("row_no"), "row_no", "left_anti"), batch)
            self.files.delete(f"{self.pending}/{name}")
            done[batch] = "replayed" if stored else "dropped"
        return done
