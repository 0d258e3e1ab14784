"""The document store: scans, lookups, hierarchy, writes and deletions, as lazy DataFrames.

A store is any DataFrame with the columns of `DOCUMENT`; `row_no` gives the
order of writing.  Mutations return the new contents, so that the caller writes
them with one job, partitioned by namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import meta as M
from ..functions import text as X
from ..functions import vectors as V

DOCUMENT = T.StructType([
    T.StructField("row_no", T.LongType()), T.StructField("id", T.StringType()), T.StructField("namespace", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("text", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("layer", T.ByteType()), T.StructField("parent_id", T.StringType()),
    T.StructField("children_ids", T.StringType()), T.StructField("keywords", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("written_at", T.TimestampNTZType()),
])


def page(df: DataFrame, offset: int, limit: int, namespace: str | None = None, order: str = "row_no") -> DataFrame:
    """Rows offset+1 to offset+limit in the order of writing."""
    df = df if namespace is None else df.where(F.col("namespace") == namespace)
    return df.orderBy(order).offset(offset).limit(limit)


def in_namespace(df: DataFrame, namespace: str, predicate: str | None = None) -> DataFrame:
    df = df.where(F.col("namespace") == namespace)
    return df if predicate is None else df.where(F.expr(predicate))


def lookup(df: DataFrame, namespace: str, id_: str, order: str = "row_no") -> DataFrame:
    """The row first written under the key, if any."""
    return df.where((F.col("namespace") == namespace) & (F.col("id") == id_)).orderBy(order).limit(1)


def layer_predicate(layer: int | None) -> Column:
    """Outer also takes flat rows; None takes all."""
    if layer is None:
        return F.lit(True)
    return F.col("layer").isin(0, 1) if layer == 1 else F.col("layer") == layer


def first_written(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (namespace, id), the first written; rows without a key are left out."""
    # one aggregate a column: over numbers that is a hash aggregation without a sort
    keyed = df.where((F.col("namespace") != "") & (F.col("id") != "")).groupBy("namespace", "id")
    return keyed.agg(F.min("row_no").alias("_first"), *[F.min_by(c, "row_no").alias(c) for c in keep]).withColumnRenamed("_first", "row_no").select("namespace", "id", "row_no", *keep)


def family(df: DataFrame, namespace: str, id_: str) -> Column:
    """Membership in the family of an id: the row itself, or a row made from it."""
    return (F.col("namespace") == namespace) & ((F.col("id") == id_) | F.coalesce(M.text_value(M.parsed(), "original_id") == id_, F.lit(False)))


def children(df: DataFrame) -> DataFrame:
    """(namespace, parent_id, pos, child_id, child_row): listed children that exist, in the order of the list."""
    listed = df.select("namespace", F.col("id").alias("parent_id"), F.posexplode(M.string_array("children_ids")).alias("pos", "child_id"))
    rows = df.groupBy("namespace", F.col("id").alias("child_id")).agg(F.min("row_no").alias("child_row"))
    return listed.join(rows, ["namespace", "child_id"]).select("namespace", "parent_id", F.col("pos").cast("long").alias("pos"), "child_id", "child_row")


def parents(df: DataFrame) -> DataFrame:
    """(namespace, id, parent_id, parent_row) for rows whose parent exists."""
    rows = df.groupBy("namespace", F.col("id").alias("parent_id")).agg(F.min("row_no").alias("parent_row"))
    return df.where(F.col("parent_id").isNotNull()).select("row_no", "namespace", "id", "parent_id").join(rows, ["namespace", "parent_id"])


def orphans(df: DataFrame) -> DataFrame:
    """Rows whose parent id occurs nowhere."""
    ids = df.select(F.col("id").alias("parent_id")).distinct()
    return df.where(F.col("parent_id").isNotNull()).join(ids, "parent_id", "left_anti")


def invalid_reason(dim: int) -> Column:
    """Why a row may not be written, null if it may."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "empty id")
        .when(F.coalesce(F.col("namespace"), F.lit("")) == "", "empty namespace")
        .when(v.isNull() | (F.size(v) == 0), "empty vector")
        .when(F.size(v) != dim, "wrong dimension")
        .when(bad, "value not finite")
    )


def batch_new(batch: DataFrame, stored: DataFrame, order: str = "row_no") -> DataFrame:
    """Rows of a batch to write: the first per key, of those the first per (namespace, hash), of those the ones whose hash isn't stored.

    Rows without a hash are kept.  Hashes are compared per namespace.
    """
    by_key = Window.partitionBy("namespace", "id").orderBy(order)
    by_hash = Window.partitionBy("namespace", "content_hash").orderBy(order)
    one = batch.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")
    hashed = one.where(F.col("content_hash").isNotNull()).withColumn("_n", F.row_number().over(by_hash)).where("_n = 1").drop("_n")
    known = stored.where(F.col("content_hash").isNotNull()).select("namespace", "content_hash").distinct()
    return hashed.join(known, ["namespace", "content_hash"], "left_anti").select(*batch.columns).unionByName(one.where(F.col("content_hash").isNull()))


def new_hashes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(namespace, content_hash) of a batch that the store doesn't hold."""
    return batch.select("namespace", "content_hash").where(F.col("content_hash").isNotNull()).distinct().join(stored.select("namespace", "content_hash").distinct(), ["namespace", "content_hash"], "left_anti")


def without_key(df: DataFrame, namespace: str, id_: str) -> DataFrame:
    return df.where(~(F.col("namespace").eqNullSafe(namespace) & F.col("id").eqNullSafe(id_)))


def without_namespace(df: DataFrame, namespace: str) -> DataFrame:
    return df.where(~F.col("namespace").eqNullSafe(namespace))


def without_matching(df: DataFrame, namespace: str, **kw) -> DataFrame:
    """Rows but those of a namespace that a metadata filter takes."""
    return df.where(~(F.col("namespace").eqNullSafe(namespace) & M.meta_filter(M.parsed(), **kw)))


def without_family(df: DataFrame, namespace: str, id_: str) -> DataFrame:
    return df.where(~F.coalesce(family(df, namespace, id_), F.lit(False)))


def upserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with the families of the rows' keys replaced by the rows."""
    keys = rows.select("namespace", F.col("id").alias("_id")).distinct()
    owner = F.coalesce(M.text_value(M.parsed(), "original_id"), F.col("id"))
    kept = df.withColumn("_id", owner).join(keys, ["namespace", "_id"], "left_anti").drop("_id").join(keys.withColumnRenamed("_id", "id"), ["namespace", "id"], "left_anti")
    return kept.select(*df.columns).unionByName(rows.select(*df.columns))


def imported(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Export records to write: with their hash or that of their text, one per (namespace, hash), none that is stored."""
    hashed = records.withColumn("content_hash", F.coalesce("content_hash", X.content_hash("text")))
    one = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("namespace", "content_hash").orderBy("rec_no"))).where("_n = 1").drop("_n")
    return one.join(stored.where(F.col("content_hash").isNotNull()).select("namespace", "content_hash").distinct(), ["namespace", "content_hash"], "left_anti")


def best_of_family(df: DataFrame, namespace: str, id_: str) -> DataFrame:
    """The row with the id itself, else the family's flattest layer and lowest chunk."""
    rows = df.where(family(df, namespace, id_))
    chunk = F.coalesce(F.try_variant_get(M.parsed(), "$.chunk_index", "long"), F.lit(0))
    return rows.withColumn("_direct", F.when(F.col("id") == id_, 0).otherwise(1)).withColumn("_chunk", chunk).orderBy("_direct", "layer", "_chunk", "row_no").limit(1).drop("_direct", "_chunk")


def allowed(namespace: str, token: str | None, tokens: dict[str, str], enabled: bool = True) -> bool:
    """Access to a namespace: open unless it has a token, which then must match."""
    import hmac

    kept = tokens.get(namespace)
    return not enabled or kept is None or (token is not None and hmac.compare_digest(kept, token))


def usable(dim: int = 64) -> Column:
    return V.usable("vector", dim)
