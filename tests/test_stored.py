"""Tables with versions, the store and its index, the indexing stream, and clients of embedding servers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import admin, durable, embed, pairs, search, turns
from lorekeep.operators import store as S
from lorekeep.operators.keywords import KeywordIndex
from lorekeep.operators.stored import DualStore, Store
from lorekeep.sources import given
from lorekeep.sources.versions import Buckets
from lorekeep.streaming.control import Control, Governor, streamed
from lorekeep.streaming.pipeline import chunk_rows, index_stream


def rows(spark, values):
    """Stored rows from (row_no, namespace, id, text)."""
    df = spark.createDataFrame(values, "row_no long, namespace string, id string, text string")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT.fields])


DOCS = [(1, "a", "x", "quick brown fox"), (2, "a", "y", "quick red fox"), (3, "b", "x", "slow brown bear"), (4, "b", "z", None), (5, None, "n", "quick quick"), (6, "a", "x", "brown brown again"), (7, "a:b", "x", "")]


def test_buckets(spark, tmp_path):
    kind = S.T.StructType().add("k", "string").add("v", "integer")
    t = Buckets(spark, str(tmp_path / "t"), kind, "k", 4)
    assert t.read().count() == 0 and t.compact() == []
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], kind)
    t.append(df, "one")
    t.append(df, "one")  # a repeated attempt
    t.append(df.limit(0), "none")
    again = Buckets(spark, str(tmp_path / "t"), kind, "k", 99)
    assert again.buckets == 4 and sorted(r.v for r in again.read().collect()) == [1, 2, 3]
    state = t.manifest.newest()
    again.rewrite(again.of(["a"]), lambda r: r.where(~F.col("k").eqNullSafe("a")))
    assert sorted(r.v for r in t.read().collect()) == [2, 3]
    with pytest.raises(RuntimeError):
        t.manifest.commit(state, tables=[])
    for i in range(3):
        t.append(df, f"more{i}")
    assert t.compact(2) and t.compact(2) == [] and t.read().count() == 11
    t.vacuum()
    assert t.read().count() == 11


def test_store_mutations(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    assert s.documents().count() == 0 and s.documents("a").count() == 0
    s.append(rows(spark, DOCS), "b0")
    s.append(rows(spark, DOCS), "b0")
    left = lambda: sorted(r.row_no for r in s.documents().collect())
    assert left() == [1, 2, 3, 4, 5, 6, 7] and s.documents("a").count() == 3
    s.delete_key("a", "y")
    assert left() == [1, 3, 4, 5, 6, 7]
    s.delete_namespace("a")
    assert left() == [3, 4, 5, 7]  # the namespace a:b is another one
    s.upsert(rows(spark, [(10, "b", "x", "new"), (11, "c", "q", "new")]))
    assert left() == [4, 5, 7, 10, 11]
    assert not s.tidy() and s.tidy(most_parts=0) and left() == [4, 5, 7, 10, 11]


def brute(docs, query, gone=()):
    df = docs.where(~F.col("row_no").isin(*gone)) if gone else docs
    return {(r.row_no, round(r.score, 9)) for r in search.bm25_scores(df, query).where("score is not null").collect()}


def test_keyword_index(spark, tmp_path):
    docs = rows(spark, DOCS)
    index = KeywordIndex(spark, str(tmp_path / "k"), 4)
    assert index.scores("fox").count() == 0
    for part in (0, 1, 1):
        index.add(docs.where(F.col("row_no") % 2 == part), f"b{part}")
    got = lambda q, **kw: {(r.row_no, round(r.score, 9)) for r in index.scores(q, **kw).collect()}
    for q in ("quick brown", "fox", "nothing here", ""):
        assert got(q) == brute(docs, q)
    assert {r for r, _ in got("brown", first=True)} == {1, 3} or {r for r, _ in got("brown", first=True)} == {3, 6}  # one row of a/x is first, by batch
    index.delete("a", ["y"])
    assert got("quick brown") == brute(docs, "quick brown", (2,))
    index.compact()
    assert got("quick brown") == brute(docs, "quick brown", (2,)) and index.gone.read().count() == 0
    index.delete("a")
    assert got("quick brown") == brute(docs, "quick brown", (1, 2, 6))
    plan = index.postings.read(index.postings.of(["fox"]))._jdf.inputFiles()
    assert len(plan) < len(index.postings.read()._jdf.inputFiles())


def test_recovery_of_dual_writes(spark, tmp_path):
    both = DualStore(spark, str(tmp_path / "d"))
    docs = rows(spark, DOCS)
    both.write(docs.where("row_no <= 3"), "b0")
    both.files.create(f"{both.pending}/b1.json", json.dumps({"batch_id": "b1", "status": "pending"}))
    both.store.append(docs.where("row_no > 3"), "b1")  # stopped before the index
    both.files.create(f"{both.pending}/b2.json", json.dumps({"batch_id": "b2", "status": "pending"}))  # stopped before the store
    assert both.recover() == {"b1": "replayed", "b2": "dropped"} and both.recover() == {}
    assert sorted(r.row_no for r in both.index.rows.read().collect()) == [1, 2, 3, 5, 6, 7]
    both.files.create(f"{both.pending}/b3.json", json.dumps({"batch_id": "b3", "status": "pending"}))
    more = rows(spark, [(8, "c", "x", "quick eel")])
    both.store.append(more, "b3")
    both.write(more.withColumn("row_no", F.lit(9).cast("long")), "b3")  # tried again: what is stored is finished
    assert both.files.names(both.pending) == [] and {r.row_no for r in both.index.scores("eel").collect()} == {8}
    both.delete("c")
    both.delete("a", "y")
    both.delete("b")
    assert sorted(r.row_no for r in both.store.documents().collect()) == [1, 5, 6, 7]
    assert {r.row_no for r in both.index.scores("quick brown").collect()} == {1, 5, 6}


@pytest.mark.parametrize("mode", ["flat", "onion", "onion-fast"])
def test_indexing_stream(spark, tmp_path, mode):
    long = "A sentence about the parser. " * 40
    feed = str(tmp_path / "feed")
    files = spark.createDataFrame([("a.md", long), ("b.md", long), ("c.md", ""), ("d.md", None), ("e.md", "short note")], "path string, text string")
    files.coalesce(1).write.parquet(feed)
    both = DualStore(spark, str(tmp_path / "d"))
    index_stream(spark, feed, both, "ns", str(tmp_path / "mark"), mode)
    first = sorted((r.id, r.row_no) for r in both.store.documents("ns").collect())
    spark.createDataFrame([("f.md", long), ("g.md", "another note")], "path string, text string").coalesce(1).write.mode("append").parquet(feed)
    index_stream(spark, feed, both, "ns", str(tmp_path / "mark"), mode)
    stored = both.store.documents("ns").collect()
    assert {json.loads(r.metadata)["path"] for r in stored} == {"a.md", "e.md", "g.md"} and len({r.row_no for r in stored}) == len(stored)
    assert set(first) <= {(r.id, r.row_no) for r in stored} and all(len(r.vector) == 64 for r in stored)
    assert both.index.scores("another").count() >= 1
    with pytest.raises(ValueError):
        chunk_rows(files, "ns", "other")


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/rerank":
            out = {"results": [{"index": i, "relevance_score": len(d)} for i, d in enumerate(body["documents"])][::-1]}
        elif self.path == "/broken":
            out = {"data": []}
        else:
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_clients_and_choice_of_provider(spark, server):
    good, broken = (lambda: embed.HttpEmbedder(f"{server}/embed", "m")), (lambda: embed.HttpEmbedder(f"{server}/broken", "m"))
    assert good().embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
    assert embed.HttpReranker(f"{server}/rerank", "m").score("q", ["a", "bb"]) == [1.0, 2.0] and embed.HttpReranker(f"{server}/rerank", "m").score("q", []) == []
    dead = lambda: embed.HttpEmbedder("http://127.0.0.1:9/none", "m", timeout=1)
    assert embed.first_working([dead, broken, embed.HashedEmbedder, good], 2) is good
    with pytest.raises(ValueError, match="no embedder"):
        embed.first_working([dead, good], 3)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bcd")], "k int, text string")
    assert {r.k: r.vector for r in embed.embedded(df, ["k"], make=good).collect()} == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0]}


def test_hashed_vectors_equal_a_loop():
    def one(text, dim=64):
        v = [0.0] * dim
        for w in text.lower().split():
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            v[h % dim] += 1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    texts = ["The quick Brown fox", "", "  ", "zażółć gęślą jaźń zażółć", "a " * 50, "x" * 300]
    for got, text in zip(embed.HashedEmbedder().embed(texts), texts, strict=True):
        assert got == pytest.approx(one(text))
    assert embed.HashedEmbedder().embed([]) == []


def test_query_escape():
    assert search.escaped('a+b (c) "d"') == 'a\\+b \\(c\\) \\"d\\"' and search.escaped("plain") == "plain"


def test_running_total_and_means(spark):
    df = spark.createDataFrame([(i * 3, i % 5) for i in range(500)], "k long, v int")
    got = {r.k: r.t for r in turns.running_total(df, "k", "v", "t", width=16).collect()}
    total = 0
    for i in range(500):
        assert got[i * 3] == total
        total += i % 5
    ema = [r.ema for r in admin.smoothed(spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 3.0)], "d string, v double"), "d", "v").orderBy("d").collect()]
    assert ema == pytest.approx([1.0, 1.3, 1.81])


def test_merge_keeps_rows_without_hash(spark):
    a = spark.createDataFrame([(1, "h"), (2, None), (3, None)], "row_no long, content_hash string").withColumn("namespace", F.lit("n"))
    got = {(r.source, r.row_no): r.copied for r in admin.merged([a, a]).collect()}
    assert got == {(0, 1): True, (1, 1): False, **{(s, n): True for s in (0, 1) for n in (2, 3)}}


def test_pairs_in_cells(spark):
    df = spark.createDataFrame([(i, "hot" if i < 40 else f"g{i % 7}") for i in range(70)] + [(99, None), (98, None)], "k long, g string")
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if (a < 40) == (b < 40) and (a < 40 or a % 7 == b % 7)}
    for chunk in (1000, 7):
        got = [(r.a, r.b) for r in pairs.pairs_within(df, "g", "k", chunk=chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert durable.bytes_of(df.limit(0)) == 0


def test_pause_and_stop_of_a_run(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(f"{i}.md", f"note number {i}") for i in range(4)], "path string, text string").repartition(4).write.parquet(feed)
    both, mark = DualStore(spark, str(tmp_path / "d")), str(tmp_path / "mark")
    c = Control()
    c.pause()
    run = threading.Thread(target=index_stream, args=(spark, feed, both, "ns", mark), kwargs={"files_per_batch": 1, "control": c})
    run.start()
    run.join(5)
    assert run.is_alive() and both.store.documents().count() == 0
    c.stop()
    run.join(60)
    assert not run.is_alive() and both.store.documents().count() == 0
    index_stream(spark, feed, both, "ns", mark, files_per_batch=1)
    assert both.store.documents("ns").count() == 4


def test_governor():
    g = Governor()
    assert (g.items, g.chars) == (32, 64_000)
    g.took(0.1)
    g.took(0.1)
    assert (g.items, g.chars) == (48, 96_000)
    for _ in range(9):
        g.took(0.1)
    assert (g.items, g.chars) == (64, 128_000)
    for _ in range(20):
        g.failed()
    assert (g.items, g.chars) == (1, 4000)
    g.took(1.0)
    assert g.items == 1


def test_governed_requests(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(100)], "k int, text string")
    plain = sorted((r.k, r.vector) for r in embed.embedded(df, ["k"]).collect())
    assert sorted((r.k, r.vector) for r in embed.embedded(df, ["k"], govern=Governor).collect()) == plain


def test_streamed_results(spark):
    df = spark.range(5).select("id", F.struct("id").alias("s"))
    events = list(streamed(df))
    assert events[0] == ("start", {"columns": ["id", "s"]}) and events[-1] == ("done", {"rows": 5}) and events[1] == ("row", {"id": 0, "s": {"id": 0}})
    bad = list(streamed(spark.range(1).select(F.raise_error(F.lit("no")))))
    assert bad[-1][0] == "error"


def test_given_texts_and_settings(spark, tmp_path, monkeypatch):
    assert given.given_row(spark, "n", "i", None, '{"a": 1}', lambda: "from input").first().text == "from input"
    for bad in ({"text": "  "}, {"text": "x", "metadata": "[1]"}, {"text": "x", "metadata": "{"}):
        with pytest.raises(ValueError):
            given.given_row(spark, "n", "i", **bad)
    file = tmp_path / "c.toml"
    file.write_text("[store]\nfolder = 'x'\n")
    monkeypatch.delenv(given.CONFIG_VARIABLE, raising=False)
    assert given.config(paths=()) == ({}, None) and given.config(paths=("/none", str(file)))[0] == {"store": {"folder": "x"}}
    monkeypatch.setenv(given.CONFIG_VARIABLE, str(file))
    assert given.config()[1] == str(file)
    with pytest.raises(FileNotFoundError):
        given.config(str(tmp_path / "none.toml"))
