"""Read, chunk, embed and store as one stream: new files become rows of the store and its keyword index exactly once.

The checkpoint remembers the files, the store remembers the micro-batches: one
that comes again is left out whole.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import embed as E
from ..operators import slicing as D
from ..operators.durable import written
from ..operators.stored import DualStore
from .control import Control

MODES = ("flat", "onion", "onion-fast")
SOURCE = T.StructType().add("path", "string").add("text", "string")


def chunk_rows(files: DataFrame, namespace: str, mode: str = "flat") -> DataFrame:
    """Rows to store, without vectors, of files (path, text): windows or layers, with the path and the file's hash on every one."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    hashed = files.where(F.length("text") > 0).select("path", "text", X.content_hash("text").alias("file_hash"))
    if mode == "flat":
        parts = D.window_chunks(hashed, ["path", "file_hash"]).select(
            F.concat_ws("_", "path", F.col("chunk_index").cast("string")).alias("id"), F.col("chunk").alias("text"), F.lit(0).cast("tinyint").alias("layer"),
            F.lit(None).cast("string").alias("parent_id"), F.lit("[]").alias("children_ids"), F.lit("[]").alias("keywords"), "path", "file_hash", F.col("chunk_index").cast("long").alias("part"),
        )
    else:
        made = D.sliced(hashed.withColumn("metadata", F.lit(None).cast("string")), ["path", "file_hash"], fast=mode == "onion-fast")
        parts = made.select("id", F.col("content").alias("text"), F.col("layer").cast("tinyint").alias("layer"), "parent_id", F.to_json("children_ids").alias("children_ids"), F.to_json("keywords").alias("keywords"), "path", "file_hash", F.col("layer").cast("long").alias("part"))
    meta = F.to_json(F.struct("path", "file_hash", F.col("part").alias("chunk_index"), F.lit(mode).alias("slice_mode")))
    return parts.select("id", F.lit(namespace).alias("namespace"), "text", meta.alias("metadata"), "layer", "parent_id", "children_ids", "keywords", X.content_hash("text").alias("content_hash"), "file_hash")


def index_stream(spark: SparkSession, source: str, store: DualStore, namespace: str, checkpoint: str, mode: str = "flat", make=E.HashedEmbedder, files_per_batch: int = 1000, control: Control | None = None) -> None:
    """Take in the Parquet files of (path, text) in `source` that are new, until none is left or `control` stops the run.

    A run that is stopped has stored whole micro-batches; the next one goes on behind them.

    Files whose text the namespace has, and repeats inside a batch, are left
    out; of equal texts the one with the smallest path is kept.
    """
    control = control or Control()
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        if not control.gate():
            raise InterruptedError("stopped")
        name = f"{namespace}-{number}"
        store.recover()  # of an attempt that was lost on its way
        if name in store.store.table.manifest.newest()["batches"]:
            return
        one = batch.where(F.length("text") > 0).groupBy(X.content_hash("text").alias("h")).agg(F.min_by("text", "path").alias("text"), F.min("path").alias("path"))
        known = store.store.documents(namespace).select(F.get_json_object("metadata", "$.file_hash").alias("h")).where("h is not null").distinct()
        chunks = chunk_rows(one.join(known, "h", "left_anti").select("path", "text"), namespace, mode).drop("file_hash")
        rest = [c for c in chunks.columns if c != "text"]
        # written once: rows are numbered, stored and indexed from it
        rows = written(E.embedded(chunks, [*rest, "text"], "text", make), "chunks")
        numbered = rows.withColumn("row_no", F.lit(number) * F.lit(1 << 44) + F.monotonically_increasing_id()).withColumn("written_at", F.current_timestamp().cast("timestamp_ntz"))
        store.write(written(numbered, "rows"), name)
        store.store.tidy()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not control.stopped:
            raise
