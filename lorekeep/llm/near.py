"""Near-duplicate records: pigeonhole blocks over set fingerprints.

A text's fingerprint has LANES lanes, each the minimum of a random hash over
the text's word runs, so two texts agree in a lane with the probability of
their similarity.  The lanes are split into BLOCKS blocks.  By the pigeonhole
principle two fingerprints that differ in fewer than BLOCKS lanes have a block
in common; records are joined on (group, block number, block value).  One bit
of every lane makes a bit fingerprint; joined pairs whose Hamming distance is
over `max_distance` are dropped (none if it is None), and the exact similarity
of the word runs decides on the rest.

Records with equal sets of word runs form a class.  Only one representative of
each class is joined, so copies cost no pairs.  Blocks with one member are left
out by a count before anything is paired, and those with more than pairs.CHUNK
are dealt to cells of at most about CHUNK by CHUNK rows, so no task holds a whole
block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import pairs_within
from ._spark import cut, written
from ._words import mix, shingle_sets, slices

BLOCKS, PER_BLOCK = 32, 4
LANES = BLOCKS * PER_BLOCK
MAX_DISTANCE = 41  # of LANES bits; at similarity 0.7 the mean is 19.2 and the deviation 4.0

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)


def fingerprints(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block values (rows x BLOCKS) and bit fingerprints (rows x 2) of non-empty id sets."""
    n = len(offsets) - 1
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    lanes = np.empty((LANES, n), np.uint64)
    for j in range(LANES):
        lanes[j] = np.minimum.reduceat((x * _MUL[j] + _ADD[j]) >> np.uint64(24), offsets[:-1])
    lanes = mix(lanes)
    blocks = np.zeros((n, BLOCKS), np.uint64)
    for b in range(BLOCKS):
        h = np.full(n, b + 1, np.uint64)
        for j in range(b * PER_BLOCK, (b + 1) * PER_BLOCK):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + lanes[j])
        blocks[:, b] = h
    bits = np.zeros((n, 2), np.uint64)
    for j in range(LANES):
        bits[:, j % 2] |= (lanes[j] & np.uint64(1)) << np.uint64(j // 2)
    return blocks.view(np.int64), bits.view(np.int64)


def _featured(df: DataFrame, text: str, n: int) -> DataFrame:
    """`df` without `text`, with n_runs, class hash, bits and blocks; rows without a run of n words are left out."""
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in ("_class", "_bits_a", "_bits_b")), T.StructField("_runs", T.IntegerType()), T.StructField("_blocks", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for at, part in slices(texts):
                ids, offsets = shingle_sets(part, n)
                has = np.flatnonzero(np.diff(offsets))
                if not len(has):
                    continue
                size = np.diff(offsets)[has]
                starts = np.concatenate((offsets[has], offsets[-1:]))
                blocks, bits = fingerprints(ids, starts)
                same = mix(np.add.reduceat(mix(ids.astype(np.uint64)), starts[:-1]) + size.astype(np.uint64)).view(np.int64)
                kept = batch.select([f.name for f in rest]).take(pa.array(has + at))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BLOCKS), pa.array(blocks.ravel()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(same), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(size.astype(np.int32)), flat], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _run_sets(df: DataFrame, text: str, n: int) -> DataFrame:
    """`df` with `text` replaced by `_set`, the sorted ids of its word runs."""
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("_set", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(text).to_pylist()):
                ids, offsets = shingle_sets(part, n)
                kept = batch.select([f.name for f in rest]).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


class NearCopies:
    """Classes of equal word-run sets and links between similar classes.

    `records` needs unique `key`, `group` and `text` columns; other columns are
    ignored.  `first` (default `key`) and `identity` give live-row semantics:
    where `identity` columns are named, only the row with the smallest key of
    each (group, identity) counts, and `where` applies after that choice.
    Null or short texts have no word runs and are in no class and no link.
    `least` is the similarity (shared runs by all runs of either) as a
    fraction (numerator, denominator).
    """

    def __init__(self, records: DataFrame, key="row_no", group="namespace", text="text", n=5, least=(8, 10), identity=(), extra=(), where=None, max_distance=MAX_DISTANCE):
        self.key, self.group, self.text, self.n, self.least, self.max_distance = key, group, text, n, least, max_distance
        self.source = records.select(key, group, text)
        cols = list(dict.fromkeys([key, group, *identity, *extra, text]))
        base = records.select(*cols)
        for c in (group, *identity):
            base = base.where(F.col(c) != "") if identity else base.where(F.col(c).isNotNull())
        if identity:
            # features are smaller than texts, so they are what is shuffled to find the live rows;
            # a live row without word runs must still hide later rows of its key
            seen = base.drop(text).groupBy(group, *identity).agg(F.min(key).alias("_first"), F.min_by(F.struct(*extra), F.col(key)).alias("_x")) if extra else base.drop(text).groupBy(group, *identity).agg(F.min(key).alias("_first"))
            if extra:
                seen = seen.select(group, *identity, "_first", "_x.*")
            if where is not None:
                seen = seen.where(where)
            live_keys = seen.select(F.col("_first").alias(key))
            feats = _featured(base.select(key, group, text), text, n).join(live_keys, key, "left_semi")
        else:
            feats = _featured(base.where(where) if where is not None else base.select(key, group, text), text, n)
        self.features = written(feats.select(key, group, "_class", "_bits_a", "_bits_b", "_runs", "_blocks"), "near")

    def members(self) -> DataFrame:
        """(key, group, class_key): every record with word runs, and the smallest key of its class."""
        reps = self.features.groupBy(self.group, "_class").agg(F.min(self.key).alias("class_key"))
        return self.features.select(self.key, self.group, "_class").join(reps, [self.group, "_class"]).select(self.key, self.group, "class_key")

    def _representatives(self) -> DataFrame:
        cols = ("_bits_a", "_bits_b", "_blocks")
        best = F.min_by(F.struct(self.key, *cols), F.col(self.key)).alias("_r")
        return self.features.groupBy(self.group, "_class").agg(best).select(self.group, "_r.*")

    def class_links(self) -> DataFrame:
        """(group, a, b, shared, total) for similar class representatives a < b."""
        key, group = self.key, self.group
        half = self._representatives().select(
            F.col(key).alias("k"), F.col("_bits_a").alias("p"), F.col("_bits_b").alias("q"), F.explode("_blocks").alias("v"), F.xxhash64(group).alias("g")
        ).select(F.xxhash64("g", "v").alias("block"), "k", "p", "q")

        def near(x, y):
            return F.bit_count(x["p"].bitwiseXOR(y["p"])) + F.bit_count(x["q"].bitwiseXOR(y["q"])) <= self.max_distance

        pairs = pairs_within(half, "block", "k", None if self.max_distance is None else near, ("p", "q")).distinct()
        pairs = written(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct()
        sets = written(_run_sets(self.source.join(wanted, key, "left_semi"), self.text, self.n), "sets")
        left = sets.select(F.col(key).alias("a"), F.col(group).alias("_g"), F.col("_set").alias("_sa"))
        right = sets.select(F.col(key).alias("b"), F.col(group).alias("_h"), F.col("_set").alias("_sb"))
        shared = F.size(F.array_intersect("_sa", "_sb"))
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .where(F.col("_g") == F.col("_h"))
            .select(F.col("_g").alias(group), "a", "b", shared.alias("shared"), (F.size("_sa") + F.size("_sb")).alias("_both"))
            .select(group, "a", "b", "shared", (F.col("_both") - F.col("shared")).alias("total"))
            .where(F.col("shared") * self.least[1] >= F.col("total") * self.least[0])
        )

    def all_pairs(self, links: DataFrame) -> DataFrame:
        """(a, b) for every linked pair of records a < b, copies expanded; its size is that of the result asked for."""
        m = cut(self.members())
        within = pairs_within(m.select("class_key", F.col(self.key).alias("k")), "class_key", "k")
        across = (
            links.select(F.col("a").alias("_p"), F.col("b").alias("_q"))
            .join(m.select(F.col("class_key").alias("_p"), F.col(self.key).alias("_x")), "_p")
            .join(m.select(F.col("class_key").alias("_q"), F.col(self.key).alias("_y")), "_q")
            .select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
        )
        return within.union(across)


def groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, group_key): connected components of `links` (a, b) over `nodes` (node), named by their smallest node.

    Every round, each node takes the smallest name among its own, its
    neighbours' and that of the node it is named after (pointer jumping), so
    the number of rounds grows with the logarithm of the longest path.  Nothing
    but a change count comes to the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    name = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name")).select(F.col("a").alias("node"), "name"))
    while True:
        near = both.join(name.select(F.col("node").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near")).select(F.col("a").alias("node"), "near")
        hop = name.select(F.col("node").alias("name"), F.col("name").alias("jump"))
        nxt = cut(name.join(near, "node").join(hop, "name").select("node", F.least("near", "jump").alias("new"), F.col("name").alias("old")))
        changed = nxt.where(F.col("new") != F.col("old")).limit(1).count()
        name = nxt.select("node", F.col("new").alias("name"))
        if not changed:
            return nodes.join(name, "node", "left").select("node", F.coalesce("name", "node").alias("group_key"))


def near_copies_of_store(spark, base) -> NearCopies:
    docs = spark.read.parquet(f"{base}/mcp_documents.parquet")
    return NearCopies(docs, n=3, least=(7, 10), identity=("id",), extra=("layer",), where=F.col("layer").isin(0, 4))


def p5_found(spark, base) -> DataFrame:
    near = near_copies_of_store(spark, base)
    return near.all_pairs(near.class_links()).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p5_groups(spark, base) -> DataFrame:
    """One row per record with words: its class, links of the class to others, copies, and group of near copies."""
    near = near_copies_of_store(spark, base)
    links = cut(near.class_links().select("a", "b"))
    m = cut(near.members())
    size = m.groupBy("class_key").agg(F.count("*").alias("copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_key")).groupBy("class_key").agg(F.count("*").alias("links"))
    comp = groups(links, size.select(F.col("class_key").alias("node"))).select(F.col("node").alias("class_key"), "group_key")
    info = size.join(degree, "class_key", "left").join(comp, "class_key")
    return m.join(info, "class_key").select("row_no", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "group_key")
