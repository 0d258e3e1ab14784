"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import bytes_of, cut, shared_folder, small, written

__all__ = ["bytes_of", "cut", "in_parts", "live_keys", "shared_folder", "small", "spread", "written"]


def live_keys(df: DataFrame, *keep: str) -> DataFrame:
    """(namespace, row_no, keep) of the live rows: non-empty id and namespace, and the smallest row_no of their key.

    `keep` should be numbers: then the choice is a hash aggregation that shuffles nothing else.
    """
    firsts = [F.min_by(c, "row_no").alias(c) for c in keep]
    return df.where((F.col("id") != "") & (F.col("namespace") != "")).groupBy("namespace", "id").agg(F.min("row_no").alias("_first"), *firsts).select("namespace", F.col("_first").alias("row_no"), *keep)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in partitions by `keys`, several per core, for groups that cost more time than bytes; they are not coalesced."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def in_parts(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """`df` with `parts` of its group `g` from `sizes` (g, parts), 1 where it isn't given; only groups of several parts are joined."""
    many = cut(sizes.where("parts > 1").select("g", "parts"))
    return df.join(small(many), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
