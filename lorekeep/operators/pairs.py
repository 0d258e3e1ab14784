"""Pairs of rows with an equal key, in cells of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written

CHUNK = 2000  # members of a group that are paired in one cell


def pairs_within(df: DataFrame, by: str, k: str, keep=None, carry: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """(a, b) for rows of `df` with equal `by` and keys a < b; `keep(x, y)` may compare the columns `carry` of both.

    Rows that are alone are dropped after a count, which combines before its
    shuffle; groups of more than `chunk` rows are dealt to cells.
    """
    chunk = chunk or CHUNK
    count = df.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / chunk).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), k), F.col("_c")).cast("int")
    shared = df.select(by, k, *carry).join(count, by).withColumn("_c", chunks).withColumn("_o", own).drop("_n")
    shared = written(shared, "shared")
    x = shared.select(by, F.col("_o").alias("_i"), F.explode(F.sequence("_o", F.col("_c") - 1)).alias("_j"), F.struct(k, *carry).alias("x"))
    y = shared.select(by, F.explode(F.sequence(F.lit(0), "_o")).alias("_i"), F.col("_o").alias("_j"), F.struct(k, *carry).alias("y"))
    met = x.join(y, [by, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"x.{k}") < F.col(f"y.{k}")))
    if keep is not None:
        met = met.where(keep(F.col("x"), F.col("y")))
    return met.select(F.least(f"x.{k}", f"y.{k}").alias("a"), F.greatest(f"x.{k}", f"y.{k}").alias("b"))
