"""Near copies, history, vectors and mixing against brute force and on edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import history, mixing, near, vectors
from lorekeep.operators import pairs
from lorekeep.llm.history import Segment


def made_texts(n, seed=1):
    r = random.Random(seed)
    voc = [f"v{i}" for i in range(300)]
    base = [[r.choice(voc) for _ in range(60)] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice(voc)], [r.choice(voc), r.choice(voc)]])
        out.append(" ".join(w))
    return out


def shingles(t, n=3):
    w = (t or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def sim(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


EDGE = [None, "", "one two", "a b c", "a b c", "A  b, C!", "a a a a a a a", "A a a", "x y x y x y x y", "x y x y", "p q r s t", "p q r s t u", "o p q r s t"]


def test_near_links_match_brute_force(spark):
    texts = made_texts(90) + EDGE
    rows = [(i, f"g{i % 2}", t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_no long, namespace string, text string, _class string")
    nc = near.NearCopies(df, n=3, least=(7, 10))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in nc.all_pairs(nc.class_links()).collect()}
    s = [shingles((t or "").lower().replace(",", "").replace("!", "")) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i % 2 == j % 2 and sim(s[i], s[j]) >= 0.7}
    assert got == want and want


def test_large_blocks_are_dealt_to_cells(spark, monkeypatch):
    """Variants of a template share blocks; one class has many copies.  Small cells and no bit filter give the same links."""
    r = random.Random(6)
    voc = [f"v{i}" for i in range(200)]
    base = [r.choice(voc) for _ in range(80)]
    texts = [" ".join(r.choice(voc) if r.random() < 0.03 else w for w in base) for _ in range(120)] + [" ".join(base)] * 30 + EDGE
    df = spark.createDataFrame([(i, "hot" if i % 10 else "other", t) for i, t in enumerate(texts)], "row_no long, namespace string, text string")
    s = [shingles((t or "").lower().replace(",", "").replace("!", "")) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (i % 10 == 0) == (j % 10 == 0) and sim(s[i], s[j]) >= 0.7}
    for chunk, distance in ((2000, 41), (7, 41), (7, None)):
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        nc = near.NearCopies(df, n=3, least=(7, 10), max_distance=distance)
        got = [(x.a, x.b) for x in nc.all_pairs(nc.class_links()).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1000


def test_near_live_rows_and_copies(spark):
    t = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, "n", "a", 0, t), (2, "n", "a", 0, "something else entirely different here now"), (3, "n", "b", 0, t), (4, "n", "c", 1, t), (5, "", "d", 0, t), (6, "n", "", 0, t), (7, "m", "a", 0, t), (8, "n", "e", 4, t), (9, "n", None, 4, t), (10, "n", "f", 0, None), (11, "n", "f", 0, t)]
    df = spark.createDataFrame(rows, "row_no long, namespace string, id string, layer int, text string")
    nc = near.NearCopies(df, n=3, least=(7, 10), identity=("id",), extra=("layer",), where=F.col("layer").isin(0, 4))
    assert nc.class_links().count() == 0
    assert {(r.row_no, r.class_key) for r in nc.members().collect()} == {(1, 1), (3, 1), (8, 1), (7, 7)}
    assert {(r.a, r.b) for r in nc.all_pairs(nc.class_links()).collect()} == {(1, 3), (1, 8), (3, 8)}
    empty = near.NearCopies(df.limit(0), n=3)
    assert empty.class_links().count() == 0 and empty.members().count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 40)] + [tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(40)]
    links = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(170)], "node long")
    parent = {i: i for i in range(170)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {(x.node, x.group_key) for x in near.groups(links, nodes).collect()} == {(i, root(i)) for i in range(170)}


def test_history_matches_a_loop(spark, monkeypatch, tmp_path):
    texts = made_texts(200, 7) + EDGE
    store = [(i, f"g{i % 2}", t) for i, t in enumerate(texts[:60])]
    recs = [(i, f"g{i % 2}", 1 + i // 50, t) for i, t in enumerate(texts[60:])] + [(900, None, 1, "a b c d e"), (901, "new", 2, "a b c d e"), (902, "new", 3, "a b c d e"), (903, "new", 3, "")]
    sdf = spark.createDataFrame(store, "k long, g string, text string")
    rdf = spark.createDataFrame(recs, "k long, g string, batch int, text string")
    norm = lambda t: shingles((t or "").lower().replace(",", "").replace("!", ""))
    kept = [(g, norm(t)) for _, g, t in store]
    want = set()
    for k, g, _, t in sorted(recs, key=lambda x: (x[2], x[0])):
        s = norm(t)
        if g is not None and any(h == g and sim(s, o) >= 0.7 for h, o in kept):
            want.add(k)
        else:
            kept.append((g, s))
    rounds = history.greedy_cases
    for n, (chars, ask, sent, edges) in enumerate(((history.PART_CHARS, history.ASK_CHARS, 1 << 20, 1000), (4000, history.ASK_CHARS, 0, 1000), (4000, 9000, 1 << 20, 10), (4000, 9000, 0, 10))):
        # one part, several, several with blocks of askers; askers sent to all tasks or shuffled; links settled by rounds or by one task
        monkeypatch.setattr(history, "ASK_CHARS", ask)
        monkeypatch.setattr(history, "ASK_BROADCAST", sent)
        monkeypatch.setattr(history.History, "_stored_bytes", lambda _: 1 << 40)
        monkeypatch.setattr(history.among, "__defaults__", ((8, 10), history.PART_CHARS, ask))
        monkeypatch.setattr(history, "greedy_cases", lambda e, most=edges: rounds(e, most))
        h = history.History(spark, str(tmp_path / f"h{n}"), (7, 10), chars)
        h.add(sdf)
        assert {r.k for r in history.screen_batches(h, rdf).collect()} == want
    empty = history.History(spark, str(tmp_path / "empty"), (7, 10))
    assert history.screen_batches(empty, rdf.limit(0)).count() == 0
    empty.add(sdf.limit(0))
    assert history.screen_batches(empty, rdf.limit(0)).count() == 0 and empty.segments().count() == 0


def test_batches_to_a_history_opened_again(spark, tmp_path):
    """One batch after the other, each to a new object on the same folder, decides like all in one pass."""
    texts = made_texts(150, 11)
    rows = [(i, f"g{i % 3}", i // 25, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, g string, batch int, text string, part string")
    store, recs = df.where("batch = 0"), df.where("batch > 0")
    path = str(tmp_path / "again")
    history.History(spark, path, (7, 10), 3000, 4).add(store, "stored")
    once = {r.k for r in history.screen_batches(history.History(spark, path, (7, 10)), recs).collect()}
    got = set()
    for no in range(1, 6):
        h = history.History(spark, path, (7, 10))
        assert (h.part_chars, h.buckets) == (3000, 4)
        got |= {r.k for r in history.take_batch(h, recs.where(F.col("batch") == no), f"b{no}").collect()}
    assert got == once and got
    h = history.History(spark, path, (7, 10))
    assert h.batches() == ["stored", *(f"b{no}" for no in range(1, 6))]
    before = h.segments().count()
    h.add(store, "stored")  # a repeated attempt
    assert h.segments().count() == before
    h.vacuum()
    assert h.segments().count() == before


def test_a_batch_reads_the_partitions_of_its_groups(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i}", t) for i, t in enumerate(made_texts(20))], "k long, g string, text string")
    h = history.History(spark, str(tmp_path / "h"), (7, 10))
    h.add(df)
    plan = h.screen(df.where("k = 3"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b" in plan or "b#" in plan.split("PartitionFilters:")[1][:80]
    assert [(r.k, r.other) for r in h.screen(df.where("k = 3")).collect()] == [(3, 3)]


def test_two_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", "a b c d")], "k long, g string, text string")
    a = history.History(spark, str(tmp_path / "h"), (7, 10))
    state = a._newest()
    a.add(df, "first")
    with pytest.raises(RuntimeError):
        a._commit(state, [], ["second"])
    assert a.batches() == ["first"]


def test_segments_merge(spark, tmp_path):
    texts = made_texts(80, 3)
    rows = [(i, "g", t) for i, t in enumerate(texts)]
    h = history.History(spark, str(tmp_path / "a"), (7, 10))
    asked = spark.createDataFrame([(i, "g", t) for i, t in enumerate(made_texts(30, 9) + [texts[5]])], "k long, g string, text string")
    pairs = lambda: sorted((r.k, r.other) for r in h.screen(asked).collect())
    for s in range(0, 80, 20):
        h.add(spark.createDataFrame(rows[s : s + 20], "k long, g string, text string"))
    before, tables = pairs(), h._newest()["tables"]
    h.compact(5)
    assert h._newest()["tables"] == tables  # not due
    h.compact(4)
    assert len(tables) == 4 and h.segments().count() == 1 and [lv for _, lv in h._newest()["tables"]] == [1]
    assert pairs() == before and (30, 5) in before
    # segments that have reached the part size are never written again
    big = history.History(spark, str(tmp_path / "b"), (7, 10), part_chars=2000)
    for s in range(0, 80, 20):
        big.add(spark.createDataFrame(rows[s : s + 20], "k long, g string, text string"))
    full = {p for p, lv in big._newest()["tables"] if lv < 0}
    big.compact(2)
    assert full and full <= {p for p, _ in big._newest()["tables"]}
    assert sorted((r.k, r.other) for r in big.screen(asked).collect()) == before


def test_merged_suffixes_are_in_order():
    from lorekeep.llm._words import words

    a, b = made_texts(10, 1), made_texts(14, 2)
    segs = [Segment.of_words(np.arange(len(t)), *words(t)) for t in (a, b)]
    m, whole = segs[0].merged(segs[1]), Segment.of_words(np.arange(24), *words(a + b))
    key = lambda s: [tuple(s.padded[p : p + history.DEPTH].tolist()[: (s.padded[p : p + history.DEPTH] == 0).argmax() or None]) for p in s.suffixes]
    assert key(m) == key(whole) == sorted(key(whole))


# ---- vectors -------------------------------------------------------------------------------
def exact(x, k):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    return np.sort(-s, axis=1)[:, :k] * -1, s


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(10, 16)), 20, 0) + 0.05 * rng.normal(size=(200, 16))]).astype("f4")
    df = spark.createDataFrame([(i, "g", v.tolist(), "clash") for i, v in enumerate(x)], "row_no long, namespace string, vector array<float>, shard string")
    got = vectors.nearest(df, 5, 16, shard_rows=shard_rows).collect()
    best, s = exact(x.astype("f8"), 5)
    assert len(got) == 500 * 5 and len({(r.row_no, r.neighbour) for r in got}) == 2500
    hits = sum(s[r.row_no, r.neighbour] >= best[r.row_no, -1] - 1e-5 for r in got)
    assert hits / 2500 >= 0.9
    assert all(r.similarity == pytest.approx(s[r.row_no, r.neighbour], abs=1e-5) for r in got)


@pytest.mark.parametrize("kind", ["gaussian", "tight", "wide"])
def test_recall_of_a_whole_shard(kind):
    """16,384 vectors of 64 dimensions: own rows and rows of another shard find at least 0.95, also by arrays read back."""
    rng = np.random.default_rng(3)
    n, m = vectors.SHARD_ROWS, 800
    size = {"gaussian": 0, "tight": 60, "wide": 300}[kind]
    x = rng.normal(size=(n + m, 64)) if not size else rng.normal(size=(size, 64))[rng.integers(0, size, n + m)] + {"tight": 0.05, "wide": 0.5}[kind] * rng.normal(size=(n + m, 64))
    x = vectors.unit(x)
    base, other = x[:n], x[n:]
    graph = vectors.Graph(base)
    graph = vectors.Graph.of_arrays(64, *graph.arrays())
    keys, mine = np.arange(n), rng.choice(n, m, replace=False)
    for q, ask, own in ((base[mine], mine, mine), (other, np.arange(n, n + m), None)):
        s = q @ base.T
        if own is not None:
            s[np.arange(m), own] = -9
        least = -np.partition(-s, 4, axis=1)[:, 4] - 1e-6
        a, b, sim = vectors.answers(graph, keys, q, ask, 5, own)
        assert len(a) == 5 * m and len(set(zip(a.tolist(), b.tolist(), strict=True))) == 5 * m
        place = {k: i for i, k in enumerate(ask.tolist())}
        assert np.mean([v >= least[place[k]] for k, v in zip(a.tolist(), sim.tolist(), strict=True)]) >= 0.95


def test_recall_of_several_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)).astype("f4")
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(x.tolist())], "row_no long, namespace string, vector array<float>")
    got = vectors.nearest(df, shard_rows=2000).toPandas()
    best, s = exact(x.astype("f8"), 5)
    assert len(got) == 30_000
    assert np.mean(s[got.row_no, got.neighbour] >= best[got.row_no, -1] - 1e-5) >= 0.95


def test_vectors_edge_cases(spark):
    good = [[1.0, 0.0], [0.9, 0.1], [0.0, 2.0]]
    bad = [None, [], [0.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    rows = [(i, "g", v) for i, v in enumerate(good + bad)] + [(50, "alone", [1.0, 1.0]), (51, None, [1.0, 1.0])] + [(60 + i, "same", [1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_no long, namespace string, vector array<float>")
    got = vectors.nearest(df, 5, 2).collect()
    assert {(r.row_no, r.neighbour) for r in got if r.row_no < 50} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert not [r for r in got if r.row_no in (50, 51)]
    assert sum(r.row_no >= 60 for r in got) == 150
    assert vectors.nearest(df.limit(0), 5, 2).count() == 0


def test_extreme_values_stay_finite():
    u = vectors.unit(np.array([[3e38, 3e38], [1e-38, 0]], "f4"))
    assert np.allclose(np.linalg.norm(u, axis=1), 1)


# ---- mixing -----------------------------------------------------------------------------------
def test_water_filling():
    g = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert g["a"] == 10 and g["b"] == pytest.approx(54) and g["c"] == pytest.approx(36) and g["d"] == 0
    assert mixing.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5}
    assert sum(mixing.water_fill({"a": 0.6, "b": 0.4}, {"a": 1e9, "b": 1e9}, 77).values()) == pytest.approx(77)


def test_mix_rows(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["Big_Source", "big-source ", "small", None, "other"]), " ".join(["token"] * r.randrange(1, 30))) for i in range(400)] + [(900, "small", None), (901, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big-source", 0.4, 1), ("small", 0.59, 3), ("missing", 0.01, 2)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(docs, targets)
    t = taken.collect()
    s = {x.source: x for x in shares.collect()}
    assert {x.source for x in t} == {"big-source", "small"} and len({x.doc_id for x in t}) == len(t)
    assert all(x.copies <= {"big-source": 1, "small": 3}[x.source] for x in t) and not {900, 901} & {x.doc_id for x in t}
    assert s["missing"].mixed_tokens == 0 and sum(x.actual_share for x in s.values()) == pytest.approx(1)
    assert abs(s["small"].actual_share - 0.59) < 0.03
    assert sorted(t) == sorted(mixing.mix(docs, targets)[0].collect())
    assert sorted(t) != sorted(mixing.mix(docs, targets, seed=2)[0].collect())
    small = mixing.mix(docs, targets, total=500)[1].collect()
    assert abs(sum(x.mixed_tokens for x in small) - 500) < 60
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0 and mixing.mix(docs, targets.limit(0))[1].count() == 0


def test_token_counts_match_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["hello world", "Zażółć  gęślą\n\njaźń 123!", "<|endoftext|> it's", "", "中文 text"]
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.tokens for r in mixing.count_tokens(df).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
