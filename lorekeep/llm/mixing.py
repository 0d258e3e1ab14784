"""Mixing sources to target shares of the total size: capped water-filling.

Sizes are tokens of a public tokenizer.  A source can give at most its tokens
times its largest number of repeats.  Sources whose target is more than that
are clamped, and what they can't give goes to the others in proportion to their
targets, again and again until nothing changes.  A source that has to give e
times its tokens gives every document floor(e) times, and a seeded choice of
documents once more until their tokens fill the rest.

That choice takes documents in the order of a seeded hash.  The hash range is
cut into bins, more for larger sources; bins are counted first, so only the
documents of the one bin in which the rest ends are put in order, and no task
sees a whole source.
"""

from __future__ import annotations

import base64
import math
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # default of the parameter; the driver sends the file to the executors
#: The public splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BIN_ROWS, MOST_BINS = 256, 1 << 16  # documents of the largest source in a bin, and bins of a source
MOST_SOURCES = 100_000  # rows of the target table that may come to the driver


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lorekeep", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """`df` with `text` replaced by its number of tokens; null and empty texts have 0."""
    rest = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*rest, T.StructField(out, T.LongType())])
    df.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches):
        enc = _encoding(SparkFiles.get(os.path.basename(tokenizer)))
        for batch in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(n)], schema.names)

    return df.mapInArrow(run, schema)


def plain_source(column: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "-")


def water_fill(targets: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """Size each source gives: its share of `total`, clamped at its capacity, the excess spread over the rest by target."""
    given: dict[str, float] = {}
    free = {s: w for s, w in targets.items() if w > 0}
    left = float(total)
    while free:
        weight = math.fsum(free.values())
        full = [s for s, w in free.items() if capacity.get(s, 0) <= left * w / weight]
        if not full:
            given |= {s: left * w / weight for s, w in free.items()}
            break
        for s in full:
            given[s] = float(capacity.get(s, 0))
            del free[s]
        left = max(0.0, total - math.fsum(given.values()))
    return {s: given.get(s, 0.0) for s in targets}


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, key="doc_id", source="source", text="text", tokenizer=TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of a mix of `total` tokens (by default as many as the sources in `targets` hold).

    documents: key, source, tokens, copies of each document taken.  shares: per
    target source its target and reached share, tokens, documents, repeats of
    the whole source, and whether it was clamped.  Documents without a source,
    of another source, or without tokens are never taken.  Of repeated target
    rows of a source the shares add up and the smallest cap holds.
    """
    spark = docs.sparkSession
    goals = targets.select(plain_source("source").alias("source"), "target_share", "max_repeats").where("target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target"), F.min("max_repeats").alias("cap"))
    sized = count_tokens(docs.select(F.col(key), plain_source(source).alias("source"), F.col(text).alias("_t")).where(F.col("source").isNotNull()), "_t", "tokens", tokenizer)
    sized = written(sized.where("tokens > 0"), "sizes")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    rows = goals.join(have, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    tokens = {r.source: r.have or 0 for r in rows}
    total = sum(tokens.values()) if total is None else total
    capacity = {r.source: (r.have or 0) * max(0, r.cap or 0) for r in rows}
    scale = math.fsum(r.target for r in rows) or 1.0
    given = water_fill({r.source: r.target / scale for r in rows}, capacity, total)
    plan = []
    for r in sorted(rows, key=lambda r: r.source):
        e = given[r.source] / r.have if r.have else 0.0
        whole = min(math.floor(e + 1e-12), r.cap or 0)
        plan.append((r.source, r.target / scale, r.cap, int(r.have or 0), int(r.docs or 0), whole, float(max(0.0, given[r.source] - whole * (r.have or 0))), capacity[r.source] <= given[r.source]))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, target double, cap int, have long, docs long, whole int, rest double, clamped boolean"))

    bins_of = min(MOST_BINS, 1 << max(4, math.ceil(max((r.docs or 0 for r in rows), default=0) / BIN_ROWS).bit_length()))
    h = F.xxhash64(F.lit(seed), F.col(key))
    binned = sized.join(plan_df.select("source", "whole", "rest"), "source").withColumn("_h", h).withColumn("_bin", F.pmod("_h", F.lit(bins_of)).cast("int"))
    run = Window.partitionBy("source").orderBy("_bin")
    bins = binned.groupBy("source", "_bin", "rest").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(run))  # at most MOST_BINS rows per source
    bins = bins.select("source", "_bin", (F.col("upto") - F.col("n")).alias("before"), "upto")
    placed = binned.join(bins, ["source", "_bin"])
    inner = placed.where((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
    within = F.sum("tokens").over(Window.partitionBy("source", "_bin").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the line is taken when that brings the sum nearer to it
    edge = inner.withColumn("_sum", within + F.col("before")).select(key, "source", "tokens", "whole", (F.col("_sum") - F.col("tokens") / 2 <= F.col("rest")).cast("int").alias("extra"))
    plain = placed.where((F.col("before") >= F.col("rest")) | (F.col("upto") <= F.col("rest"))).select(key, "source", "tokens", "whole", (F.col("upto") <= F.col("rest")).cast("int").alias("extra"))
    taken = edge.union(plain).select(key, "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0")
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    shares = plan_df.join(got, "source", "left").select(
        "source", F.col("target").alias("target_share"), (F.coalesce("mixed_tokens", F.lit(0)) / F.sum("mixed_tokens").over(Window.partitionBy())).alias("actual_share"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.col("have").alias("source_tokens"), F.coalesce("mixed_documents", F.lit(0)).alias("mixed_documents"), F.col("docs").alias("source_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("cap").alias("max_repeats"), "clamped",
    )
    return taken, shares


def _mix_here(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, spark.read.parquet(f"{base}/mix_targets.parquet"))


def p7_mix(spark, base) -> DataFrame:
    return _mix_here(spark, base)[0]


def p7_shares(spark, base) -> DataFrame:
    return _mix_here(spark, base)[1]
