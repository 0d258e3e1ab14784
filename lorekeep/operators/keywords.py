"""A stored keyword index: postings in buckets by term, so a query reads the buckets of its terms.

Three tables: postings (a row per row and term), rows (what is indexed, with
lengths, for the statistics), and rows that were deleted, which searches leave
out until `compact` drops their postings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Buckets
from .durable import small, written
from .search import bm25_expression, term_array, terms_of

POSTING = T.StructType().add("term", "string").add("row_no", "long").add("first", "boolean").add("tf", "integer").add("n", "integer")
ROW = T.StructType().add("row_no", "long").add("namespace", "string").add("id", "string").add("first", "boolean").add("n", "integer")
GONE = T.StructType().add("row_no", "long").add("namespace", "string")


class KeywordIndex:
    """BM25 over rows (row_no, namespace, id, text).  `first` marks the row first written under its key."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.spark = spark
        self.postings = Buckets(spark, f"{folder}/postings", POSTING, "term", buckets)
        self.rows = Buckets(spark, f"{folder}/rows", ROW, "namespace", buckets)
        self.gone = Buckets(spark, f"{folder}/gone", GONE, "namespace", buckets)

    def add(self, df: DataFrame, batch: str | None = None) -> None:
        """Index the rows with text; a batch that is in already is left out."""
        batch = batch or uuid.uuid4().hex
        kept = df.where(F.col("text").isNotNull()).select("row_no", "namespace", "id", term_array("text").alias("terms"))
        counted = written(kept, "terms")
        keyed = (F.col("namespace") != "") & (F.col("id") != "")
        # rows without text hide later rows of their key, too
        firsts = df.where(keyed).groupBy("namespace", "id").agg(F.min("row_no").alias("row_no"))
        if self.rows.manifest.newest()["tables"]:
            firsts = firsts.join(self.rows.read().select("namespace", "id").distinct(), ["namespace", "id"], "left_anti")
        flagged = counted.join(firsts.select("row_no", F.lit(True).alias("first")), "row_no", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        flagged = written(flagged.withColumn("n", F.size("terms")), "flagged")
        tf = flagged.select("row_no", "first", "n", F.explode("terms").alias("term")).groupBy("term", "row_no").agg(F.count("*").alias("tf"), F.first("first").alias("first"), F.first("n").alias("n"))
        # postings first: a batch whose rows are in is in whole
        self.postings.append(tf, batch)
        self.rows.append(flagged, batch)

    def delete(self, namespace: str, ids: list[str] | None = None) -> None:
        """Leave out the rows of a namespace, or those with some ids."""
        found = self.rows.read(self.rows.of([namespace])).where(F.col("namespace") == namespace)
        found = found if ids is None else found.where(F.col("id").isin(*ids))
        self.gone.append(found.select("row_no", "namespace"))

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.join(small(self.gone.read().select("row_no").distinct()), "row_no", "left_anti") if self.gone.manifest.newest()["tables"] else df

    def counts(self, query: str, first: bool = False) -> DataFrame:
        """(row_no, _n, _f0..): lengths and term counts of the rows with a term of the query; only the terms' buckets are read."""
        terms = terms_of(query)
        hits = self.postings.read(self.postings.of(terms)).where(F.col("term").isin(*terms))
        hits = self._kept(hits.where("first") if first else hits)
        return hits.groupBy("row_no").agg(F.max("n").alias("_n"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i, t in enumerate(terms)])

    def scores(self, query: str, first: bool = False) -> DataFrame:
        """(row_no, score) of every row with a term of the query."""
        terms = terms_of(query)
        if not terms:
            return self.spark.createDataFrame([], "row_no long, score double")
        rows = self.rows.read()
        size = self._kept(rows.where("first") if first else rows).agg(F.count("*"), F.avg("n")).first()
        counts = written(self.counts(query, first), "counts")
        having = counts.agg(*[F.sum((F.col(f"_f{i}") > 0).cast("long")) for i in range(len(terms))]).first()
        return counts.select("row_no", bm25_expression(size[0], size[1], list(having)).alias("score"))

    def compact(self) -> None:
        """Drop the postings and rows of deleted rows, and join parts of buckets."""
        dead = self.gone.read().select("row_no").distinct()
        for table in (self.postings, self.rows):
            state = table.manifest.newest()
            if state["tables"]:
                table.rewrite(sorted({b for _, b in state["tables"]}), lambda rows: rows.join(dead, "row_no", "left_anti"))
        state = self.gone.manifest.newest()
        if state["tables"]:
            self.gone.manifest.commit(state, tables=[])
