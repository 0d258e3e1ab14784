"""Streaming intake: files become rows of the store once, however often the stream restarts.

The checkpoint remembers the files; the hash anti-join makes a repeated
micro-batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, text: str = "text", min_bytes: int = 50, files_per_batch: int = 1000) -> None:
    """Take in all Parquet files of `source` that are new and append their new texts, with hash and layer 0, to `target`.

    Texts under `min_bytes`, repeats inside a batch and texts already in
    `target` are left out.  The first of equal texts by all columns is kept.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        rows = batch.where(F.octet_length(text) >= min_bytes).withColumn("content_hash", X.content_hash(text)).withColumn("layer", F.lit(0).cast("tinyint"))
        order = F.struct(*[F.col(c) for c in batch.columns])
        one = rows.groupBy("content_hash").agg(F.min(order).alias("r"), F.first("layer").alias("layer")).select("r.*", "content_hash", "layer")
        hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(target)
        if path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(path):
            one = one.join(s.read.parquet(target).select("content_hash").distinct(), "content_hash", "left_anti").select(*one.columns)
        one.write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def activity(stream: DataFrame, ts: str, group: str, late: str = "10 minutes", window: str = "1 hour", key: str | None = None) -> DataFrame:
    """Events per window and group with a watermark, repeated deliveries of a key left out (an extension)."""
    marked = stream.withWatermark(ts, late)
    if key is not None:
        marked = marked.dropDuplicatesWithinWatermark([key])
    return marked.groupBy(F.window(ts, window), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")
