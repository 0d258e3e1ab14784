"""Intermediate data that survives lost executors: checkpoints and written tables in the folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir, which all executors share; it is removed when the application ends.

    Only on a local master, as in tests, a temporary folder stands in where
    the setting is missing; elsewhere that raises.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lorekeep_folder", None):
        return sc._lorekeep_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    folder = f"{root}/lorekeep-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    own = not sc.getCheckpointDir()
    if own:
        sc.setCheckpointDir(root)
    for made in (folder, *([sc.getCheckpointDir()] if own else [])):
        path = sc._jvm.org.apache.hadoop.fs.Path(made)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    sc._lorekeep_folder = folder
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the values of `df`, which must be cheap to read: lengths of texts, eight for others."""
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) + 4 if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema.fields), F.lit(0))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """`df`, which must be cheap to read, to be broadcast if it has at most MOST_BROADCAST_BYTES; larger ones are left to a shuffle."""
    return F.broadcast(df) if bytes_of(df) <= MOST_BROADCAST_BYTES else df
