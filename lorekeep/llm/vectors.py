"""The k most similar vectors of every vector: small-world graphs per shard.

Rows of a group are dealt to shards of about `shard_rows` rows, and each shard
gets a hierarchical navigable small-world graph kept as flat neighbour arrays
(one int32 row of neighbours per node and layer).  A shard is one row of a
written table: keys, vectors and arrays as bytes, and what its own rows found
in it.  Every graph is built once.  Rows of groups of several shards then ask
the other shards, a whole shard of askers at a time, and answers are merged.
Graphs are built and searched for whole blocks of vectors: one step of the
beam search expands the best open candidates of all queries of a block with a
few numpy calls.

How wide the search beam has to be depends on the data.  Each search tries a
sample of its queries against all vectors of the shard and doubles the beam
until the sample's recall is at least RECALL.

Similarity is the cosine.  Equal similarities are settled by the smaller key,
as far as the search sees them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import in_parts, live_keys, spread, written

M = 16  # neighbours chosen per node; layer 0 keeps up to twice as many
BUILD_BEAM, SEARCH_BEAM, EXPAND = 48, 40, 4
ENTRIES = 8  # nodes that a layer hands to the next
BLOCK = 512  # vectors searched together
SHARD_ROWS = 16384
RECALL, SAMPLE = 0.97, 200  # the least recall among so many sampled queries
FLOOR = np.float32(-4.0)


class Graph:
    """A small-world graph over unit vectors (n x d, float32)."""

    def __init__(self, x: np.ndarray, m: int = M, beam: int = BUILD_BEAM, seed: int = 7):
        self.x, self.m, self.beam = x, m, beam
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(m)).astype(np.int64), 12)
        self.order = np.argsort(-level, kind="stable")  # higher nodes come first, so each layer is a prefix
        self.x = x[self.order]
        self.counts = [int((level >= lv).sum()) for lv in range(int(level.max(initial=0)) + 1)] if n else []
        tops: list[np.ndarray] = []
        for lv in reversed(range(len(self.counts))):
            tops.append(self._layer(tops, self.counts[lv], 2 * m if lv == 0 else m))
        self.layers = tops[::-1]

    def _layer(self, above: list[np.ndarray], count: int, width: int) -> np.ndarray:
        """Neighbour array of the first `count` nodes; `above` are the layers above, highest first."""
        x = self.x
        nb = np.full((count, width), -1, np.int32)
        head = min(count, max(64, 4 * self.m))
        sims = x[:head] @ x[:head].T
        np.fill_diagonal(sims, FLOOR)
        k = min(head - 1, self.beam)
        if k < 1:
            return nb
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        self._connect(nb, np.arange(head), cand.astype(np.int32), np.take_along_axis(sims, cand, 1))
        at = head
        while at < count:
            end = min(count, at + max(64, min(4 * BLOCK, at // 2)))
            ids = np.arange(at, end)
            got, sim = [], []
            for s in range(at, end, BLOCK):
                q = x[s : min(s + BLOCK, end)]
                start = self._descend(q, above)
                start = np.where(start < at, start, start % at)  # entries that aren't linked in this layer yet are swapped for some that are
                start.sort(axis=1)
                start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
                a, b = self._beam(q, nb, start, at, self.beam)
                got.append(a)
                sim.append(b)
            found, close = np.vstack(got), np.vstack(sim)
            own = x[at:end] @ x[at:end].T  # vectors of the same block don't meet in the graph yet
            np.fill_diagonal(own, FLOOR)
            k = min(end - at - 1, self.beam // 2)
            if k > 0:
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                found = np.hstack((found, (best + at).astype(np.int32)))
                close = np.hstack((close, np.take_along_axis(own, best, 1)))
            self._connect(nb, ids, found, close)
            at = end
        return nb

    def _choose(self, cand: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
        """Up to `width` of each row's candidates: near ones first, those closer to a chosen one than to the row only as fill."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : max(self.beam, 2 * width)]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        rows, c = cand.shape
        ok = sim > FLOOR
        v = self.x[np.maximum(cand, 0)]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros((rows, c), bool)
        worst = np.full((rows, c), FLOOR, np.float32)  # highest similarity to a chosen one
        number = np.zeros(rows, np.int64)
        for j in range(c):
            pick = ok[:, j] & (worst[:, j] < sim[:, j]) & (number < width)
            taken[:, j] = pick
            number += pick
            worst = np.where(pick[:, None], np.maximum(worst, mutual[:, j, :]), worst)
        rank = np.where(taken, np.arange(c), np.where(ok, c + np.arange(c), 2 * c))
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        return np.where(np.take_along_axis(rank, first, 1) < 2 * c, np.take_along_axis(cand, first, 1), -1).astype(np.int32)

    def _connect(self, nb: np.ndarray, ids: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Choose neighbours for `ids`, and add the links back, choosing again where a row overflows."""
        width = nb.shape[1]
        for s in range(0, len(ids), BLOCK):
            part = self._choose(cand[s : s + BLOCK], sim[s : s + BLOCK], min(self.m, width))
            nb[ids[s : s + BLOCK], : part.shape[1]] = part
        chosen = nb[ids, : min(self.m, width)]
        to, frm = chosen.ravel(), np.repeat(ids, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[to], self.x[frm]), to))
        to, frm = to[order], frm[order]
        uniq, first, number = np.unique(to, return_index=True, return_counts=True)
        keep = np.minimum(number, width)  # the nearest `width` links back stand for the choice
        for s in range(0, len(uniq), BLOCK):
            u, f, k = uniq[s : s + BLOCK], first[s : s + BLOCK], keep[s : s + BLOCK]
            grid = np.arange(width)
            new = np.where(grid < k[:, None], frm[np.minimum(f[:, None] + grid, len(frm) - 1)], -1)
            both = np.hstack((nb[u], new.astype(np.int32)))
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.matmul(self.x[np.maximum(both, 0)], self.x[u][:, :, None])[:, :, 0]
            near = np.where(both >= 0, near, FLOOR)
            nb[u] = self._choose(both, near, width)

    def _descend(self, q: np.ndarray, above: list[np.ndarray]) -> np.ndarray:
        """Entry nodes for the next layer, -1 where there are fewer: a narrow beam on each layer from the top."""
        at = np.zeros((len(q), 1), np.int32)
        for nb in above:
            at = self._beam(q, nb, at, len(nb), ENTRIES)[0]
        return at

    def _beam(self, q: np.ndarray, nb: np.ndarray, start: np.ndarray, count: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the `beam` nearest of the first `count` nodes found from `start`, nearest first."""
        rows, d = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((rows, count + 1), bool)  # the last column takes what is no node
        node = np.full((rows, beam), -1, np.int32)
        sim = np.full((rows, beam), FLOOR, np.float32)
        opened = np.ones((rows, beam), bool)
        w = min(start.shape[1], beam)
        first = start[:, :w]
        node[:, :w] = first
        sim[:, :w] = np.where(first >= 0, np.matmul(self.x[np.maximum(first, 0)], q[:, :, None])[:, :, 0], FLOOR)
        opened[:, :w] = first < 0
        seen[d, np.where(first >= 0, first, count)] = True
        active = np.arange(rows)
        while len(active):
            a = active[:, None]
            todo = np.where(opened[active], FLOOR, sim[active])
            e = min(EXPAND, beam)
            pick = np.argpartition(-todo, e - 1, axis=1)[:, :e]
            live_ = np.take_along_axis(todo, pick, 1) > FLOOR
            opened[a, pick] = True
            src = np.where(live_, node[a, pick], -1)
            near = np.where(src[:, :, None] >= 0, nb[np.maximum(src, 0)], -1).reshape(len(active), -1)
            near = np.where((near < count) & (near >= 0), near, count)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = count
            near = np.where(seen[a, near], count, near)
            seen[a, near] = True
            real = near < count
            s = np.where(real, np.matmul(self.x[np.where(real, near, 0)], q[active][:, :, None])[:, :, 0], FLOOR)
            alln = np.hstack((node[active], np.where(real, near, -1)))
            alls = np.hstack((sim[active], s))
            allo = np.hstack((opened[active], ~real))
            top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            node[active] = np.take_along_axis(alln, top, 1)
            sim[active] = np.take_along_axis(alls, top, 1)
            opened[active] = np.take_along_axis(allo, top, 1)
            active = active[(~opened[active]).any(1)]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)

    def search(self, q: np.ndarray, k: int, beam: int, own: np.ndarray | None = None):
        """Yields (first query, original numbers, similarities) block by block; `own` are the queries' own numbers, where they are in the graph."""
        if not len(self.x):
            return
        base, place = self.layers[0], np.empty(len(self.x), np.int32)
        place[self.order] = np.arange(len(self.x))
        beam = max(beam, k + 1)
        for s in range(0, len(q), BLOCK):
            part = q[s : s + BLOCK]
            if own is None:
                start = self._descend(part, self.layers[:0:-1])
            else:  # a node that is in the graph was led to its place when it was linked
                me = place[own[s : s + BLOCK]]
                start = np.hstack((me[:, None], base[me]))
            node, sim = self._beam(part, base, start, len(self.x), beam)
            yield s, np.where(node >= 0, self.order[np.maximum(node, 0)], -1)[:, : k + 1], sim[:, : k + 1]

    def beam_for(self, q: np.ndarray, k: int, own: np.ndarray | None = None) -> int:
        """The beam that gives a sample of the queries RECALL against a look at all vectors."""
        if not len(q) or not len(self.x):
            return SEARCH_BEAM
        at = np.unique(np.linspace(0, len(q) - 1, min(len(q), SAMPLE)).astype(np.int64))
        every = q[at] @ self.x.T  # SAMPLE x the rows of a shard
        most = min(k + (own is not None), len(self.x))  # with itself
        least = -np.partition(-every, most - 1, axis=1)[:, most - 1] - 1e-6
        beam = SEARCH_BEAM
        while beam < len(self.x):
            got = sum(int((sim[:, :most] >= least[s : s + len(sim), None]).sum()) for s, _, sim in self.search(q[at], k, beam, None if own is None else own[at]))
            if got >= RECALL * most * len(at):
                break
            beam *= 2
        return beam

    def arrays(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.x, self.order.astype(np.int32), np.array(self.counts, np.int32), np.concatenate([nb.ravel() for nb in self.layers]) if self.layers else np.empty(0, np.int32))]

    @classmethod
    def of_arrays(cls, dim: int, x, order, counts, layers, m: int = M) -> Graph:
        g = cls.__new__(cls)
        g.m, g.beam = m, BUILD_BEAM
        g.x, g.order, g.counts = np.frombuffer(x, np.float32).reshape(-1, dim), np.frombuffer(order, np.int32), np.frombuffer(counts, np.int32).tolist()
        flat, at, g.layers = np.frombuffer(layers, np.int32), 0, []
        for lv, n in enumerate(g.counts):
            width = 2 * m if lv == 0 else m
            g.layers.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        return g


def answers(graph: Graph, keys: np.ndarray, q: np.ndarray, ask: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, neighbour, similarity) of the k nearest of the graph's nodes (`keys` in original order) for the queries `q` of keys `ask`.

    The search works with float32; similarities of what it finds are made again with float64.
    """
    ks, ns, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float64)]
    place = np.empty(len(graph.x), np.int64)
    place[graph.order] = np.arange(len(graph.x))
    for s, node, sim in graph.search(q, k, graph.beam_for(q, k, own), own):
        who = ask[s : s + len(node)]
        good = (node >= 0) & (sim > FLOOR) & (keys[node] != who[:, None])
        good &= np.cumsum(good, axis=1) <= k
        r, c = np.nonzero(good)
        ks.append(who[r])
        ns.append(keys[node[r, c]])
        ss.append(np.einsum("ij,ij->i", q[s + r].astype(np.float64), graph.x[place[node[r, c]]].astype(np.float64)))
    return np.concatenate(ks), np.concatenate(ns), np.concatenate(ss)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares of extreme values stay finite
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column, dim: int) -> np.ndarray:
    arr = pa.array(column, pa.list_(pa.float32())) if not isinstance(column, pa.Array) else column
    return np.asarray(arr.flatten()).reshape(-1, dim)


def valid_vector(column: str, dim: int):
    """`column` has `dim` finite values that are not all zero; null is not valid."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda v: v != 0), F.lit(False))


FOUND = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])
PARTS = ("keys", "x", "order", "counts", "layers")
SHARD = T.StructType([
    T.StructField("g", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("parts", T.IntegerType()),
    *(T.StructField(c, T.BinaryType()) for c in (*PARTS, "k", "n", "s")),
])


def graphs(rows: DataFrame, k: int, dim: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard for rows (k, g, v): its graph, and the k nearest in it of each of its own rows (k, n, s)."""
    base = in_parts(rows, rows.groupBy("g").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")))
    base = base.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "k"), F.col("parts")).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        keys = t.column("k").to_numpy()
        order = np.argsort(keys, kind="stable")  # the same graph wherever and however often the task runs
        keys, x = keys[order], unit(_matrix(t.column("v").chunk(0), dim))[order]
        graph = Graph(x)
        found = answers(graph, keys, x, keys, k, np.arange(len(x)))
        blobs = [keys.tobytes(), *graph.arrays(), *(f.tobytes() for f in found)]
        return pa.table([*(t.column(c)[:1] for c in ("g", "shard", "parts")), *(pa.array([b], pa.binary()) for b in blobs)], SHARD.names)

    return spread(base, "g", "shard").groupBy("g", "shard").applyInArrow(run, SHARD)


def nearest(rows: DataFrame, k: int = 5, dim: int = 64, key="row_no", group="namespace", vector="vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, neighbour, similarity, rank): for every row the k nearest others of its group.

    Rows with a null group or an invalid vector neither ask nor answer; a group
    with fewer rows gives fewer answers.  Rows are dealt to shards by a hash of
    their key, as many as the size of their group needs, so no task holds more
    than about `shard_rows` rows to index and as many to answer at a time.
    Askers of a group of several shards go to each of the others, so vectors
    moved there are rows times shards.
    """
    base = rows.select(F.col(key).cast("long").alias("k"), F.col(group).alias("g"), F.col(vector).cast("array<float>").alias("v")).where(valid_vector("v", dim) & F.col("g").isNotNull())
    made = written(graphs(written(base, "vectors"), k, dim, shard_rows), "graphs")

    def own(batches):
        for t in batches:
            cols = [np.concatenate([np.empty(0, d), *(np.frombuffer(v.as_buffer(), d) for v in t.column(c))]) for c, d in (("k", np.int64), ("n", np.int64), ("s", np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], FOUND.names)

    def foreign(batches):
        for t in batches:
            for i in range(t.num_rows):
                graph = Graph.of_arrays(dim, *(t.column(c)[i].as_buffer() for c in PARTS[1:]))
                ask = np.frombuffer(t.column("ask")[i].as_buffer(), np.int64)[np.frombuffer(t.column("ask_order")[i].as_buffer(), np.int32)]
                q = np.frombuffer(t.column("q")[i].as_buffer(), np.float32).reshape(-1, dim)
                found = answers(graph, np.frombuffer(t.column("keys")[i].as_buffer(), np.int64), q, ask, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], FOUND.names)

    several = made.where("parts > 1")
    asks = several.select("g", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), F.col("keys").alias("ask"), F.col("order").alias("ask_order"), F.col("x").alias("q")).where("shard != home")
    met = spread(several.select("g", "shard", *PARTS), "g", "shard").join(spread(asks, "g", "shard"), ["g", "shard"])
    got = made.select("k", "n", "s").mapInArrow(own, FOUND).unionByName(met.select(*PARTS, "ask", "ask_order", "q").mapInArrow(foreign, FOUND))
    order = Window.partitionBy("k").orderBy(F.desc("s"), "n")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("k").alias(key), F.col("n").alias("neighbour"), F.col("s").alias("similarity"), "rank")


def store_vectors(spark, base) -> DataFrame:
    """(namespace, row_no, vector) of the live rows; they are chosen on keys, before vectors are read."""
    docs = spark.read.parquet(f"{base}/mcp_documents.parquet").select("row_no", "id", "namespace", "vector")
    return docs.select("row_no", "namespace", "vector").join(live_keys(docs).select("row_no"), "row_no", "left_semi")


def p4_found(spark, base) -> DataFrame:
    n = nearest(store_vectors(spark, base))
    return n.select(F.least("row_no", "neighbour").alias("row_a"), F.greatest("row_no", "neighbour").alias("row_b")).distinct()


def p4_neighbours(spark, base) -> DataFrame:
    """The 5 nearest rows of every live row with a valid vector."""
    return nearest(store_vectors(spark, base)).withColumn("similarity", F.round("similarity", 4))
