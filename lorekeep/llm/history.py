"""New batches against all history: immutable suffix arrays.

Accepted texts are kept as segments.  A segment is one row of a Parquet table:
the concatenated words of some texts of one group as numbers of its own sorted
dictionary, a 0 behind each text, and the array of its suffixes in the order of
their first words, all as bytes.  Segments are never changed.  Every batch adds
a table of its own; a manifest names the tables that count.  FAN tables of one
level are merged into one of the next, and segments that have reached the part
size are never touched again, so a text is rewritten a logarithmic number of
times.  A history is opened again from its folder alone.

A record asks the segments of its group: every run of N words that the record
has is looked up by binary search, and each interval of suffixes found names
the texts that hold the run.  A text at the wanted similarity shares at least
that part of the record's runs, so the runs with the longest intervals, one
less than that part, need not be expanded, and no text is lost.  The matches of
a record and a text are then counted in full: their coverage, the shared runs
by all runs of either, decides.  (The similarity counts runs of N words
wherever they stand, so a longer match can't be made a condition.)

Tables are partitioned by a hash of the group; a batch reads the partitions of
its groups only.  Large groups are dealt to several segments of at most about
PART_CHARS characters, and their records to blocks of ASK_CHARS; every block
asks every segment, so no task holds a whole group.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Files, Manifest
from ._spark import bytes_of, cut, in_parts, live_keys, shared_folder, small, spread, written
from ._words import ID_BITS, runs, shingle_sets, slices, words

DEPTH = 4  # words by which suffixes are put in order
PART_CHARS, ASK_CHARS = 6 << 20, 16 << 20  # of the texts of one segment, and of the records that ask one in a task
N = 3  # words of a run
BUCKETS = 32  # partitions of the tables of a history
FAN = 4  # tables of one level that are merged
MOST_EDGES = 2_000_000  # links that one task settles in order
ASK_BROADCAST = 64 << 20  # bytes of askers that may be sent to all executors
CELL = 4  # blocks of askers that one task puts to a segment
ARRAYS = {"keys": np.int64, "starts": np.int32, "dictionary": np.uint64, "text": np.int32, "suffixes": np.int32}
SEGMENT = T.StructType([
    T.StructField("g", T.StringType()), T.StructField("part", T.StringType()), T.StructField("words", T.IntegerType()),
    *(T.StructField(c, T.BinaryType()) for c in ARRAYS), T.StructField("full", T.BooleanType()), T.StructField("b", T.IntegerType()),
])
LINKS = T.StructType([T.StructField("k", T.LongType()), T.StructField("other", T.LongType())])


def _all_words(texts) -> tuple[np.ndarray, np.ndarray]:
    w, r = [], []
    for at, part in slices(texts):
        a, b = words(part)
        w.append(a)
        r.append(b + at)
    return (np.concatenate(w), np.concatenate(r)) if w else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Segment:
    def __init__(self, keys, starts, dictionary, text, suffixes):
        self.keys, self.starts, self.dictionary, self.text, self.suffixes = keys, starts, dictionary, text, suffixes
        self.padded = np.concatenate((text, np.zeros(DEPTH, np.int32)))

    @classmethod
    def of_words(cls, keys: np.ndarray, w: np.ndarray, row: np.ndarray) -> Segment:
        dictionary, number = np.unique(w, return_inverse=True)
        count = np.bincount(row, minlength=len(keys))
        starts = np.concatenate(([0], np.cumsum(count + 1))).astype(np.int32)
        text = np.zeros(int(starts[-1]), np.int32)
        text[np.arange(len(w)) + row] = number + 1
        rank = text.astype(np.int64)
        owner = np.repeat(np.arange(len(keys)), count + 1)
        step = 1
        while step < DEPTH and len(text):
            later = np.zeros_like(rank)
            later[:-step or None] = np.where(owner[:-step] == owner[step:], rank[step:], 0) if len(rank) > step else 0
            rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        return cls(keys, starts, dictionary, text, order[text[order] > 0].astype(np.int32))

    def sets(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed (place in `docs`, run id) keys in order, and the number of different runs, of the texts `docs` (ascending)."""
        size = self.starts[docs + 1] - self.starts[docs] - 1
        row = np.repeat(np.arange(len(docs)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[docs], size)
        return packed_sets(self.dictionary[self.text[inside] - 1], row, len(docs))

    def intervals(self, number: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with the `length` words at each position of `number` (word numbers)."""
        first = np.searchsorted(self.text[self.suffixes], np.arange(len(self.dictionary) + 2))
        out = []
        for upper in (False, True):
            lo, hi = first[number[at]], first[number[at] + 1]
            todo = np.flatnonzero(lo < hi)
            while len(todo):
                mid = (lo[todo] + hi[todo]) >> 1
                p, q = self.suffixes[mid].astype(np.int64), at[todo]
                right = np.full(len(todo), upper)  # go right where the suffix is below, or equal on the upper search
                open_ = np.arange(len(todo))
                for k in range(1, length):
                    a, b = self.padded[p[open_] + k], number[q[open_] + k]
                    right[open_[a < b]] = True
                    right[open_[a > b]] = False
                    open_ = open_[a == b]
                    if not len(open_):
                        break
                lo[todo] = np.where(right, mid + 1, lo[todo])
                hi[todo] = np.where(right, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            out.append(lo)
        return out[0], out[1]

    def merged(self, other: Segment) -> Segment:
        """Both texts one behind the other; the suffixes of `other` are placed among the own ones by binary search."""
        dictionary = np.union1d(self.dictionary, other.dictionary)
        mine = np.concatenate(([0], np.searchsorted(dictionary, self.dictionary) + 1)).astype(np.int32)
        theirs = np.concatenate(([0], np.searchsorted(dictionary, other.dictionary) + 1)).astype(np.int32)
        left = Segment(self.keys, self.starts, dictionary, mine[self.text], self.suffixes)
        text = theirs[other.text]
        pad = np.concatenate((text, np.zeros(DEPTH, np.int32)))
        # equal prefixes up to DEPTH words: the own suffixes come first
        place = left.intervals_full(pad, other.suffixes.astype(np.int64))
        return Segment(
            np.concatenate((self.keys, other.keys)), np.concatenate((self.starts, other.starts[1:] + self.starts[-1])).astype(np.int32), dictionary,
            np.concatenate((left.text, text)), np.insert(self.suffixes, place, other.suffixes + np.int32(len(self.text))),
        )

    def intervals_full(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Upper ends of the suffixes not above those of `number` at `at`, compared on DEPTH words or to the end of a text."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes))
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            p, q = self.suffixes[mid].astype(np.int64), at[todo]
            right = np.ones(len(todo), bool)
            open_ = np.arange(len(todo))
            for k in range(DEPTH):
                a, b = self.padded[p[open_] + k], number[q[open_] + k]
                right[open_[a > b]] = False
                open_ = open_[(a == b) & (a > 0)]
                if not len(open_):
                    break
            lo[todo] = np.where(right, mid + 1, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def row(self, g: str, part: str, most: int, bucket: int) -> dict:
        """The segment as a row of SEGMENT; it is full from half of `most` words on."""
        arrays = {c: np.ascontiguousarray(getattr(self, c), t).tobytes() for c, t in ARRAYS.items()}
        return {"g": g, "part": part, "words": len(self.text), **arrays, "full": 2 * len(self.text) >= most, "b": bucket}

    @classmethod
    def of_row(cls, table, i: int) -> Segment:
        return cls(*(np.frombuffer(table.column(c)[i].as_buffer(), t) for c, t in ARRAYS.items()))


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"words": pa.int32(), "full": pa.bool_(), "b": pa.int32(), "g": pa.string(), "part": pa.string()}
    return pa.table({c: pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in SEGMENT.names})


def packed_sets(w: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = runs(w, row, N)
    key = np.sort((row[at].astype(np.uint64) << np.uint64(ID_BITS)) | (h >> np.uint64(64 - ID_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key, np.bincount((key >> np.uint64(ID_BITS)).astype(np.int64), minlength=rows)


def _candidates(segment: Segment, w: np.ndarray, row: np.ndarray, rows: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(record, text of the segment) that may be similar: texts with one of the record's rarer runs.

    A similar text has at least the share `least` of the record's different
    runs, so one run less than that share may be left out, and those with the
    longest intervals are.
    """
    h, at = runs(w, row, N)
    order = np.lexsort((h, row[at]))
    r, hh = row[at][order], h[order]
    new = np.concatenate((np.ones(min(1, len(r)), bool), (r[1:] != r[:-1]) | (hh[1:] != hh[:-1])))
    at, r = at[order][new], r[new]  # different runs of each record
    spare = -(-np.bincount(r, minlength=rows) * least[0] // least[1]) - 1
    place = np.minimum(np.searchsorted(segment.dictionary, w), len(segment.dictionary) - 1)
    number = np.where(segment.dictionary[place] == w, place + 1, 0).astype(np.int32)
    known = number[at] > 0
    for k in range(1, N):
        known &= number[at + k] > 0
    at, r = at[known], r[known]
    lo, hi = segment.intervals(number, at, N)
    size = hi - lo
    hit = size > 0
    lo, size, r = lo[hit], size[hit], r[hit]
    order = np.lexsort((-size, r))
    lo, size, r = lo[order], size[order], r[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    keep = nth >= spare[r]
    lo, size, r = lo[keep], size[keep], r[keep]
    found = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    doc = np.searchsorted(segment.starts, segment.suffixes[found], "right") - 1
    pair = np.unique((np.repeat(r, size).astype(np.int64) << 32) | doc)
    return pair >> 32, pair & 0xFFFFFFFF


def similar(segment: Segment, w: np.ndarray, row: np.ndarray, rows: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(record, text of the segment) for all at the least similarity; records are given by their words."""
    none = np.empty(0, np.int64)
    if not len(w) or not len(segment.suffixes):
        return none, none
    q, d = _candidates(segment, w, row, rows, least)
    if not len(q):
        return none, none
    # exact similarity: the record's runs are looked up among the text's
    own, own_n = packed_sets(w, row, rows)
    docs, d = np.unique(d, return_inverse=True)
    have, have_n = segment.sets(docs)
    # sizes alone rule out some
    few, many = np.minimum(own_n[q], have_n[d]), np.maximum(own_n[q], have_n[d])
    ok = few * least[1] >= many * least[0]
    q, d = q[ok], d[ok]
    begin = np.concatenate(([0], np.cumsum(own_n)))
    hits = np.zeros(len(q), np.int64)
    mask = np.uint64((1 << ID_BITS) - 1)
    for s in range(0, len(q), 4096):
        a, b = q[s : s + 4096], d[s : s + 4096]
        n = own_n[a]
        idx = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[a], n)
        key = (own[idx] & mask) | (np.repeat(b, n).astype(np.uint64) << np.uint64(ID_BITS))
        j = np.minimum(np.searchsorted(have, key), len(have) - 1)
        hits[s : s + 4096] = np.add.reduceat((have[j] == key).astype(np.int64), np.cumsum(n) - n) if len(n) else 0
    ok = hits * least[1] >= (own_n[q] + have_n[d] - hits) * least[0]
    return q[ok], docs[d[ok]]


def parts_of(items: DataFrame, chars: int) -> DataFrame:
    """(g, parts): how many segments the items (g, chars) of each group need."""
    return items.groupBy("g").agg(F.ceil(F.sum(F.coalesce("chars", F.lit(0)) + 16) / chars).cast("int").alias("parts"))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")


def build(items: DataFrame, name: str, part_chars: int = PART_CHARS, buckets: int = BUCKETS, sizes: DataFrame | None = None) -> DataFrame:
    """Segments of items (k long, g string, text string), dealt by key within a group; `sizes` (g, chars) may be given where it is cheaper to read."""
    sizes = items.select("g", F.length("text").alias("chars")) if sizes is None else sizes
    number = F.pmod(F.xxhash64(F.lit(3), "k"), F.col("parts")).cast("int")
    dealt = in_parts(items, parts_of(sizes, part_chars)).select("k", "g", "text", number.alias("part"), bucket_of(buckets).alias("b"))
    dealt = dealt.withColumn("s", F.pmod(F.col("part"), F.lit(1024)))
    most = part_chars // 4

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        w, row = _all_words(t.column("text").to_pylist())
        seg = Segment.of_words(t.column("k").to_numpy(), w, row)
        return _table([seg.row(t.column("g")[0].as_py(), f"{name}.{t.column('part')[0].as_py()}", most, t.column("b")[0].as_py())])

    # groups of one bucket come to one task, so a table has few files; the parts of a large group are spread
    return spread(dealt, "b", "s").groupBy("b", "s", "g", "part").applyInArrow(run, SEGMENT)


class History:
    """Segments in a folder: `add` appends a batch, `screen` asks, `compact` merges.

    `folder` holds `data/d=<table>/full=<bool>/b=<bucket>` and `manifest/<version>.json`;
    the newest manifest names the tables with their levels, the batches that are in, and the settings.
    A writer that loses a race to the next manifest raises, and its table is ignored.
    """

    def __init__(self, spark, folder: str, least=(8, 10), part_chars: int = PART_CHARS, buckets: int = BUCKETS):
        self.spark, self.folder, self.least = spark, folder, least
        self.files = Files(spark, folder)
        self.manifest = Manifest(self.files, folder, {"tables": [], "batches": []})
        state = self._newest()
        self.part_chars, self.buckets = state.get("part_chars", part_chars), state.get("buckets", buckets)

    def _newest(self) -> dict:
        return self.manifest.newest()

    def _commit(self, state: dict, tables: list, batches: list) -> None:
        self.manifest.commit(state, tables=tables, batches=batches, part_chars=self.part_chars, buckets=self.buckets)

    def _write(self, segments: DataFrame, level: int) -> list:
        """Write a table; its entries for the manifest (path, level), -1 for full segments."""
        path = f"{self.folder}/data/d=t{uuid.uuid4().hex}"
        segments.write.partitionBy("full", "b").parquet(path)
        return [[p, lv] for p, lv in ((f"{path}/full=true", -1), (f"{path}/full=false", level)) if self.files.exists(p)]

    def _read(self, tables: list) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).option("basePath", f"{self.folder}/data").parquet(*(p for p, _ in tables))

    def batches(self) -> list[str]:
        return self._newest()["batches"]

    def segments(self) -> DataFrame:
        return self._read(self._newest()["tables"])

    def add(self, items: DataFrame, batch: str | None = None, sizes: DataFrame | None = None) -> None:
        """Append accepted items (k, g, text); a batch that is in already is left out, so a repeated attempt does no harm."""
        state = self._newest()
        batch = batch or uuid.uuid4().hex
        if batch not in state["batches"]:
            made = self._write(build(items, batch, self.part_chars, self.buckets, sizes), 0)
            self._commit(state, [*state["tables"], *made], [*state["batches"], batch])

    def _asks(self, asked: DataFrame) -> DataFrame:
        """(b, g, block, keys, counts, words): the words of the asking records (k, g, text), in blocks of a bounded size."""
        sizes = asked.select("g", F.length("text").alias("chars"))
        dealt = in_parts(asked.select("k", "g", "text"), parts_of(sizes, ASK_CHARS)).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "k"), F.col("parts")).cast("int")).drop("parts").withColumn("b", bucket_of(self.buckets))

        def run(t: pa.Table) -> pa.Table:
            w, row = _all_words(t.column("text").to_pylist())
            count = np.bincount(row, minlength=t.num_rows).astype(np.int32)
            one = [t.column(c)[:1] for c in ("b", "g", "block")]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (t.column("k").to_numpy(), count, w)]
            return pa.table([*one, *blobs], ["b", "g", "block", "keys_", "counts_", "words_"])

        return written(spread(dealt, "g", "block").groupBy("b", "g", "block").applyInArrow(run, "b int, g string, block int, keys_ binary, counts_ binary, words_ binary"), "asks")

    def screen(self, asked: DataFrame) -> DataFrame:
        """(k, other): for each asking record (k, g, text) the texts of its group at the least similarity.

        Only the partitions of the groups that are asked for are read.  Words
        of the askers, not their texts, go to the segments.  A batch that is
        small beside the history is sent to all executors, so that no segment
        is shuffled: that is where a copy for every core is less than the
        tables, and at most ASK_BROADCAST bytes.
        """
        least = self.least
        asks = self._asks(asked)
        buckets = sorted(r.b for r in asks.select("b").distinct().collect())  # at most `buckets` numbers
        if not buckets:
            return self.spark.createDataFrame([], LINKS)
        wanted = self.segments().where(F.col("b").isin(buckets))
        size = bytes_of(asks)
        if size <= ASK_BROADCAST and size * self.spark.sparkContext.defaultParallelism < self._stored_bytes():
            both = wanted.join(F.broadcast(asks.drop("b")), "g")
        else:  # a block goes to each segment of its group, a segment to every CELL blocks; the join holds one segment and streams blocks
            celled = asks.withColumn("cell", F.floor(F.col("block") / CELL).cast("int"))
            copies = wanted.join(small(celled.select("b", "g", "cell").distinct()), ["b", "g"])
            both = celled.join(self._parts(buckets), ["b", "g"]).join(copies, ["b", "g", "part", "cell"])

        def run(batches):
            last, seg = None, None
            for t in batches:
                ks, os = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i in range(t.num_rows):
                    this = (t.column("g")[i], t.column("part")[i])
                    if this != last:
                        last, seg = this, Segment.of_row(t, i)
                    keys, count, w = (np.frombuffer(t.column(c)[i].as_buffer(), d) for c, d in (("keys_", np.int64), ("counts_", np.int32), ("words_", np.uint64)))
                    begin = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
                    s = 0
                    while s < len(keys):  # some 128,000 words at a time
                        e = max(s + 1, int(np.searchsorted(begin, begin[s] + (1 << 17), "right")) - 1)
                        q, d = similar(seg, w[begin[s] : begin[e]], np.repeat(np.arange(e - s), count[s:e]), e - s, least)
                        ks.append(keys[s + q])
                        os.append(seg.keys[d])
                        s = e
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.concatenate(os))], LINKS.names)

        return both.select("g", "part", *ARRAYS, "keys_", "counts_", "words_").mapInArrow(run, LINKS)

    def _stored_bytes(self) -> int:
        return sum(self.files.size(p) for p, _ in self._newest()["tables"])

    def _parts(self, buckets: list[int]) -> DataFrame:
        return self.segments().where(F.col("b").isin(buckets)).select("b", "g", "part")

    def compact(self, fan: int = FAN) -> None:
        """Merge `fan` or more tables of one level into one of the next, until no level has so many.

        Only segments under the part size are read and written again; those of
        a group are merged two at a time, the smallest first.
        """
        most = self.part_chars // 4  # words
        while True:
            state = self._newest()
            levels = [lv for _, lv in state["tables"]]
            level = min((lv for lv in levels if lv >= 0 and levels.count(lv) >= fan), default=None)
            if level is None:
                return
            old = [e for e in state["tables"] if e[1] == level]
            segs = self._read(old)
            many = cut(segs.groupBy("g").agg(F.ceil(F.sum("words") / most).cast("int").alias("parts")).where("parts > 1"))
            bins = segs.join(small(many), "g", "left").withColumn("bin", F.pmod(F.xxhash64("part"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts", "full")

            def run(t: pa.Table) -> pa.Table:
                g, bucket = t.column("g")[0].as_py(), t.column("b")[0].as_py()
                # the part name settles equal sizes, so a repeated task gives the same
                left = [(w, p, i) for i, (w, p) in enumerate(zip(t.column("words").to_pylist(), t.column("part").to_pylist(), strict=True))]
                heapq.heapify(left)
                made: dict[str, Segment] = {}
                take = lambda p, i: made.pop(p) if p in made else Segment.of_row(t, i)
                while len(left) > 1 and left[0][0] + left[1][0] <= most:
                    (_, p, i), (_, q, j) = heapq.heappop(left), heapq.heappop(left)
                    new = take(p, i).merged(take(q, j))
                    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{p} {q}").hex
                    made[name] = new
                    heapq.heappush(left, (len(new.text), name, -1))
                return _table([take(p, i).row(g, p, most, bucket) for _, p, i in sorted(left, key=lambda x: x[1])])

            merged = spread(bins, "b", "bin").groupBy("b", "bin", "g").applyInArrow(run, SEGMENT)
            made = self._write(merged, level + 1)
            self._commit(state, [*(e for e in state["tables"] if e not in old), *made], state["batches"])

    def vacuum(self) -> None:
        """Delete tables that no manifest in force names; no reader or writer may be at work on them."""
        used = {p.split("/d=")[1].split("/")[0] for p, _ in self._newest()["tables"]}
        for name in self.files.names(f"{self.folder}/data"):
            if name.startswith("d=") and name[2:] not in used:
                self.files.delete(f"{self.folder}/data/{name}")


def among(records: DataFrame, least=(8, 10), part_chars: int = PART_CHARS, ask_chars: int = 4 * ASK_CHARS) -> DataFrame:
    """(k, other): for each record (k, g, batch, text) the earlier ones of its group at the least similarity.

    Records of a large group are dealt to parts, and all of them ask each part,
    in blocks of at most about `ask_chars` characters.
    Within a part the batches come one by one: a batch asks the segments of
    those before, then itself, and adds its own segment, which is merged with
    others of its size class.
    """
    base = in_parts(records, parts_of(records.select("g", F.length("text").alias("chars")), part_chars))
    home = F.pmod(F.xxhash64(F.lit(5), "k"), F.col("parts")).cast("int")
    blocks = F.ceil(F.col("parts") * F.lit(part_chars / ask_chars)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "k"), F.col("blocks")).cast("int")
    base = base.withColumn("home", home).withColumn("blocks", blocks).withColumn("mine", mine)
    cols = ("k", "g", "batch", "text")
    kept = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*cols, F.col("home").alias("part"), "block", F.lit(True).alias("kept"), (F.col("block") == F.col("mine")).alias("asks"))
    away = base.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part != home").select(*cols, "part", F.col("mine").alias("block"), F.lit(False).alias("kept"), F.lit(True).alias("asks"))
    dealt = kept.unionByName(away)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("batch", "ascending"), ("k", "ascending")])
        keys, batch, kept, asks = (t.column(c).to_numpy() for c in ("k", "batch", "kept", "asks"))
        w, row = _all_words(t.column("text").to_pylist())
        ks, os = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        segments: list[tuple[int, Segment]] = []
        edge = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1], [True])))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            a, b = np.searchsorted(row, (s, e))
            bw, brow = w[a:b], row[a:b] - s
            told = asks[s:e][brow] if len(brow) else np.empty(0, bool)
            aw, arow = bw[told], brow[told]
            mine = kept[s:e]
            sel = mine[brow] if len(brow) else np.empty(0, bool)
            own = Segment.of_words(keys[s:e][mine], bw[sel], (np.cumsum(mine) - 1)[brow[sel]])
            for seg in (*(x for _, x in segments), own):
                q, d = similar(seg, aw, arow, e - s, least)
                k, o = keys[s + q], seg.keys[d]
                ok = (o < k) if seg is own else np.ones(len(k), bool)
                ks.append(k[ok])
                os.append(o[ok])
            level = 0
            while segments and segments[-1][0] == level:
                own, level = segments.pop()[1].merged(own), level + 1
            segments.append((level, own))
        return pa.table({"k": np.concatenate(ks), "other": np.concatenate(os)})

    return spread(dealt, "g", "part", "block").groupBy("g", "part", "block").applyInArrow(run, LINKS)


def greedy_cases(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(k): the records to turn away, if in order a record is turned away when an earlier one it is linked to (other) is not.

    Up to `most_edges` links are settled in order by one task.  As long as there
    are more, a round settles the records whose earlier partners are settled,
    and edges of settled records leave.  Only the number of edges left comes to
    the driver.
    """
    edges = cut(edges.distinct())
    out = edges.select("k").limit(0)
    while edges.count() > most_edges:
        free = edges.select(F.col("other").alias("k")).distinct().join(edges.select("k"), "k", "left_anti").select(F.col("k").alias("other"))
        gone = cut(edges.join(free, "other", "left_semi").select("k").distinct())
        edges = cut(edges.join(gone, "k", "left_anti").join(gone.select(F.col("k").alias("other")), "other", "left_anti"))
        out = out.union(gone)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "ascending")])
        gone: set[int] = set()
        for k, o in zip(t.column("k").to_pylist(), t.column("other").to_pylist(), strict=True):
            if o not in gone:
                gone.add(k)
        return pa.table({"k": pa.array(sorted(gone), pa.int64())})

    return out.union(edges.groupBy(F.lit(1).alias("_all")).applyInArrow(run, "k long"))


def _run_counts(df: DataFrame, text: str) -> DataFrame:
    """`df` with `runs`, the number of different word runs of `text`."""
    schema = T.StructType([*df.schema.fields, T.StructField("runs", T.IntegerType())])

    def run(batches):
        for batch in batches:
            n = [np.diff(shingle_sets(part, N)[1]) for _, part in slices(batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n).astype(np.int32) if n else np.empty(0, np.int32))], schema.names)

    return df.mapInArrow(run, schema)


def _texts_hash(text: str = "text"):
    """128 bits that stand for a text wherever equal texts are looked for."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def new_texts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(firsts, copies) of records (k, g, batch, text) with words to compare.

    firsts: the first record of equal texts of a group, (k, g, batch, text); copies: (k, first) for the others.
    """
    known = records.where(F.col("g").isNotNull() & F.col("text").isNotNull()).select("k", "g", "batch", _texts_hash().alias("h"))
    named = known.join(known.groupBy("g", "h").agg(F.min(F.struct("batch", "k")).alias("f")), ["g", "h"]).select("k", "g", "batch", F.col("f.k").alias("first"))
    named = cut(named)
    firsts = records.select("k", "text").join(named.where("k = first").select("k", "g", "batch"), "k").select("k", "g", "batch", "text")
    firsts = cut(_run_counts(firsts, "text").where("runs > 0").drop("runs"))
    copies = named.where("k != first").join(firsts.select(F.col("k").alias("first")), "first", "left_semi").select("k", "first")
    return firsts, copies


def screen_batches(history: History, records: DataFrame) -> DataFrame:
    """(k, duplicate_of): records turned away, and one text they repeat (a stored key, or null where it is an earlier record).

    records: (k, g, batch, text), of one batch or of several that wait; keys
    must rise with their order inside a batch, batches come in the order of
    `batch`, and all waiting batches are screened in one pass over the history.
    Null groups and texts without a run of three words repeat nothing.  The
    first record of equal texts decides for all: the others are turned away
    whether it is or not.
    """
    firsts, copies = new_texts(records)
    stored = cut(history.screen(firsts).groupBy("k").agg(F.min("other").alias("duplicate_of")))
    fresh = firsts.join(stored, "k", "left_anti")
    none = F.lit(None).cast("long").alias("duplicate_of")
    later = greedy_cases(among(fresh, history.least, history.part_chars)).select("k", none)
    same = copies.join(stored.withColumnRenamed("k", "first"), "first", "left").select("k", "duplicate_of")
    return stored.union(later).union(same)


LEAST = (7, 10)


def store_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((k, g, text), (g, chars)) of the live rows of layer 0 or 4, one row for equal texts of a namespace.

    The choice is made on numbers; texts are read once more for the rows chosen.
    """
    h = [F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in (0, 1)]
    keys = live_keys(docs.select("id", "namespace", "row_no", "layer", F.length("text").alias("chars"), *h), "layer", "chars", "h0", "h1").where(F.col("layer").isin(0, 4) & F.col("chars").isNotNull())
    keys = written(keys.groupBy("namespace", "h0", "h1").agg(F.min("row_no").alias("k"), F.min("chars").alias("chars")).select("k", F.col("namespace").alias("g"), "chars"), "texts")
    items = docs.select(F.col("row_no").alias("k"), "text").join(keys.select("k", "g"), "k").select("k", "g", "text")
    return items, keys.select("g", "chars")


def _here(spark, base) -> tuple[History, DataFrame]:
    """A history of the stored rows, in a folder of this run, and the records."""
    history = History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", LEAST)
    items, sizes = store_texts(spark.read.parquet(f"{base}/mcp_documents.parquet").select("row_no", "id", "namespace", "layer", "text"))
    history.add(items, "stored", sizes)
    records = spark.read.parquet(f"{base}/import_records.parquet").select(F.col("rec_no").alias("k"), F.col("namespace").alias("g"), F.col("batch_no").alias("batch"), "text")
    return history, records


def p3_found(spark, base) -> DataFrame:
    return screen_batches(*_here(spark, base)).select(F.col("k").alias("rec_no"))


def p3_decisions(spark, base) -> DataFrame:
    """Every import record with its decision and, where it repeats a stored row, that row."""
    history, records = _here(spark, base)
    cases = screen_batches(history, records).select(F.col("k").alias("rec_no"), "duplicate_of", F.lit(False).alias("accepted"))
    all_ = spark.read.parquet(f"{base}/import_records.parquet").select("rec_no", "batch_no")
    return all_.join(cases, "rec_no", "left").select("rec_no", "batch_no", F.coalesce("accepted", F.lit(True)).alias("accepted"), "duplicate_of")


def take_batch(history: History, records: DataFrame, batch: str) -> DataFrame:
    """(k): the records of one batch that are turned away; the others are added to the history, which is compacted where that is due.

    `records` are (k, g, batch, text).  Accepted texts without a run of three words, and copies, add nothing.
    """
    cases = cut(screen_batches(history, records).select("k"))
    firsts = records.where(F.col("g").isNotNull() & F.col("text").isNotNull()).join(cases, "k", "left_anti").select("k", "g", "text")
    history.add(firsts, batch)
    history.compact()
    return cases


def p3_batches(spark, base) -> DataFrame:
    """The decisions when the batches come one after the other, each to the history opened again from its folder."""
    history, records = _here(spark, base)
    out = None
    for (no,) in sorted(tuple(r) for r in records.select("batch").where("batch is not null").distinct().collect()):  # one number a batch
        again = History(spark, history.folder, history.least)
        cases = take_batch(again, records.where(F.col("batch") == no), f"import-{no}").select(F.col("k").alias("rec_no"), F.lit(no).alias("batch_no"))
        out = cases if out is None else out.union(cases)
    return out if out is not None else spark.createDataFrame([], "rec_no long, batch_no int")
