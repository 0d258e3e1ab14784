"""Test items that leak into training text: greedy string tiling.

Seeds: the Karp-Rabin hashes of all runs of `least` words of the items are
joined with those of the documents.  A sieve of the items' hashes, at most
SIEVE_BITS bits whatever the items hold, goes to all executors first, so only
the few runs of documents that pass it are shuffled.  Tiling: for every
(document, item) with a seed, seeds on one diagonal are merged into maximal
matches; the longest match is marked again and again, others are cut where they
overlap marked words, and what stays shorter than `least` words is dropped.
The words of the tiles by the words of the item is its coverage, whatever the
order of the passages.

Every joined seed belongs to a result, as one run of `least` words is enough
for it.  Neither items nor documents are collected, and documents are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import small, spread, written
from ._words import runs, slices, words

LEAST_WORDS = 12
SIEVE_BITS = 1 << 27  # 16 MB
SALTS = 8  # parts of a seed's documents where seeds are joined by a shuffle
FIELDS = [("tiles", T.IntegerType()), ("longest", T.IntegerType()), ("tiled_words", T.IntegerType()), ("item_words", T.IntegerType())]


def tiles(at_a: np.ndarray, at_b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, words) from the start positions of equal runs of `least` words."""
    order = np.lexsort((at_a, at_a - at_b))
    a, b = at_a[order], at_b[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(a - b) != 0) | (np.diff(a) != 1))))
    length = np.diff(np.concatenate((new, [len(a)]))) + least - 1
    left = sorted(zip((-length).tolist(), a[new].tolist(), b[new].tolist(), strict=True))
    done: list[tuple[int, int, int]] = []
    used_a = np.zeros(int(at_a.max()) + least, bool)
    used_b = np.zeros(int(at_b.max()) + least, bool)
    import heapq

    heapq.heapify(left)
    while left:
        n, i, j = heapq.heappop(left)
        n = -n
        free = ~(used_a[i : i + n] | used_b[j : j + n])
        if free.all():
            used_a[i : i + n] = used_b[j : j + n] = True
            done.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).view(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(left, (s - e, i + s, j + s))
    return done


def seeds_of(df: DataFrame, key: str, text: str, least: int, sieve=None) -> DataFrame:
    """(key, h, at, words): every run of `least` words of each text that passes the sieve, by its hash and its first word's place."""
    schema = T.StructType([df.schema[key], T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("words", T.IntegerType())])

    def run(batches):
        bits = None if sieve is None else sieve.value
        for batch in batches:
            for first, texts in slices(batch.column(text).to_pylist()):
                w, row = words(texts)
                h, at = runs(w, row, least)
                if bits is not None:
                    place = h & np.uint64(len(bits) * 64 - 1)
                    pass_ = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                    h, at = h[pass_], at[pass_]
                if len(h):
                    of = row[at]
                    begin, size = np.searchsorted(row, np.arange(len(texts))), np.bincount(row, minlength=len(texts))
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of + first)), pa.array(h.view(np.int64)), pa.array((at - begin[of]).astype(np.int32)), pa.array(size[of].astype(np.int32))], schema.names)

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def sieve_of(seeds: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the hashes: 16 to 32 bits for each, at most SIEVE_BITS; it is made by the executors, and its words that aren't 0 come to the driver."""
    size = min(SIEVE_BITS, max(1 << 10, 1 << (16 * max(1, rows)).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    parts = seeds.select(F.shiftright(place, 6).alias("i"), F.expr(f"shiftleft(1L, cast((h & {size - 1}) & 63 AS INT))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[parts.column("i").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint64)


def leaks(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text", least=LEAST_WORDS) -> DataFrame:
    """(key, item_key, tiles, longest, tiled_words, item_words) for every document and item with a common run of `least` words.

    Null and short texts leak nothing.  Keys must be unique; repeated texts under other keys each count.
    """
    spark = docs.sparkSession
    seeds = written(seeds_of(items.select(F.col(item_key).cast("long").alias("_item"), F.col(item_text).alias("_t")), "_item", "_t", least).withColumnsRenamed({"at": "item_at", "words": "item_words"}), "seeds")
    sieve = spark.sparkContext.broadcast(sieve_of(seeds, seeds.count()))
    found = seeds_of(docs.select(F.col(key).alias("_doc"), F.col(text).alias("_t")), "_doc", "_t", least, sieve).select("_doc", "h", "at")
    few = small(seeds)
    if few is not seeds:
        met = found.join(few, "h")
    else:  # a seed of many documents is met in several parts
        salted = seeds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int")).join(salted, ["h", "_salt"])
    schema = T.StructType([T.StructField("_doc", docs.schema[key].dataType), T.StructField("_item", T.LongType()), *(T.StructField(n, t) for n, t in FIELDS)])

    def run(t: pa.Table) -> pa.Table:
        done = tiles(t.column("at").to_numpy(), t.column("item_at").to_numpy(), least)
        size = [x[2] for x in done]
        numbers = (len(done), max(size), sum(size))
        return pa.table([t.column("_doc")[:1], t.column("_item")[:1], *(pa.array([n], pa.int32()) for n in numbers), t.column("item_words")[:1]], schema.names)

    tiled = spread(met.select("_doc", "_item", "at", "item_at", "item_words"), "_doc", "_item").groupBy("_doc", "_item").applyInArrow(run, schema)
    return tiled.withColumnsRenamed({"_doc": key, "_item": item_key})


def _leaks_here(spark, base) -> DataFrame:
    return leaks(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/eval_items.parquet"))


def p6_found(spark, base) -> DataFrame:
    return _leaks_here(spark, base).select("doc_id", "item_id")


def p6_leaked_items(spark, base, coverage: float = 0.5) -> DataFrame:
    """Per item: documents it leaked into, those that hold at least `coverage` of its words, and the highest coverage."""
    share = F.col("tiled_words") / F.col("item_words")
    return _leaks_here(spark, base).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.sum((share >= coverage).cast("long")).alias("mostly"), F.max(share).alias("best_coverage"), F.max("longest").alias("longest")
    )
