"""Operators on small fixtures: ties, nulls, repeats, order-dependent choices, files and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import meta as M
from lorekeep.operators import admin as A
from lorekeep.operators import clean as C
from lorekeep.operators import embed as E
from lorekeep.operators import search as Q
from lorekeep.operators import store as S
from lorekeep.operators import turns as U
from lorekeep.operators.greedy import turned_away
from lorekeep.sources import files
from lorekeep.streaming import ingest

DOC = "row_no long, id string, namespace string, text string, metadata string, layer tinyint, parent_id string, children_ids string, content_hash string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_duplicate_rows_and_empty_tables(spark):
    d = docs(spark, [(1, "a", "n", "x", None, 0, None, None, "h"), (2, "a", "n", "x", None, 0, None, None, "h"), (3, "b", "n", None, None, 1, "zz", "[\"a\"]", None)])
    assert {(r.row_no, r.kept) for r in A.duplicates(d, ["namespace"], [F.asc("row_no")]).collect()} == {(1, True), (2, False)}
    assert S.first_written(d, "text").count() == 2
    assert [r.row_no for r in S.orphans(d).collect()] == [3]
    assert [(r.parent_id, r.child_id, r.child_row) for r in S.children(d).collect()] == [("b", "a", 1)]
    empty = d.limit(0)
    assert A.quality(empty, "namespace").count() == 0 and A.overview(empty).count() == 0 and S.children(empty).count() == 0


def test_quality_extremes(spark):
    d = spark.createDataFrame([("a", ""), ("a", None), ("b", "x" * 300 + "."), ("c", "no end " * 40)], "g string, t string")
    q = {r.g: r for r in A.quality(d, "g", "t").collect()}
    assert q["a"].sentence_integrity == 1.0 and q["a"].word_integrity == 1.0 and q["a"].chunk_quality == 0.0
    assert q["b"].grade == "EXCELLENT" and q["c"].word_integrity == 0.0


def test_project_and_meta_filters(spark):
    rows = [(1, '{"project": "Atlas"}'), (2, '{"project_id": 5}'), (3, "{broken"), (4, None), (5, '{"source_project": "atlas", "date": "2026-01-02"}')]
    d = spark.createDataFrame(rows, "i int, metadata string")
    assert {r.i for r in d.where(M.in_project(M.parsed(), " ATLAS ")).collect()} == {1, 5}
    assert {r.i for r in d.where(M.in_project(M.parsed(), "")).collect()} == {1, 2, 3, 4, 5}
    assert {r.i for r in d.where(M.meta_filter(M.parsed(), date_from="2026-01-03")).collect()} == {1, 2, 3, 4}


def test_bm25_prefers_rare_terms_and_handles_no_terms(spark):
    d = spark.createDataFrame([(1, "quick brown fox"), (2, "quick red fox"), (3, "lazy dog"), (4, None)], "row_no long, text string")
    assert [r.row_no for r in Q.bm25_top(d, "quick brown", 5).collect()] == [1, 2]
    assert Q.bm25_top(d, "?!", 5).count() == 0


def test_fusion_keeps_both_sides(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2)], "row_no long, dist double")
    k = spark.createDataFrame([(2, 3.0), (3, 6.0)], "row_no long, score double")
    f = {r.row_no: r for r in Q.fused(v, k).collect()}
    assert f[1].score == pytest.approx(0.6) and f[2].score == pytest.approx(0.3 + 0.2) and f[3].score == pytest.approx(0.4)
    assert f[1].keyword_score is None and f[3].vector_score is None
    assert {r.row_no for r in Q.left_fused(v, k, 2).collect()} == {1, 2}


def test_turns_across_ranges(spark):
    roles = ["system", "user", "assistant", "user", "user", "tool"]
    rows = [("s", i * 3000, roles[i % 6], f"text {i} long enough to count") for i in range(12)]
    got = {r.block_no: r.turn for r in U.turns(spark.createDataFrame(rows, "session_id string, block_no long, role string, content string")).collect()}
    want, turn, seen = {}, 0, False
    for _, no, role, _ in rows:
        if role == "system":
            continue
        if role == "user" and seen:
            turn += 1
        want[no], seen = turn, True
    assert got == want


def test_turn_documents_drop_repeats(spark):
    rows = [("s", 1, "human", "please look at the parser"), ("s", 2, "bot", "done"), ("s", 3, "bot", "done"), ("s", 4, "user", "x")]
    d = U.turn_documents(spark.createDataFrame(rows, "session_id string, block_no long, role string, content string")).collect()
    by_turn = {r.turn: r.content for r in d}
    assert by_turn == {0: "User request:\nplease look at the parser\n\nAssistant response:\ndone"}


def test_greedy_choice_matches_a_loop(spark):
    r = random.Random(5)
    edges = {(b, a) for _ in range(150) for a, b in [sorted(r.sample(range(60), 2))]}
    df = spark.createDataFrame([("g", k, o) for k, o in edges], "g string, k int, other int")
    gone = set()
    for k in range(60):
        if any(k == x and o not in gone for x, o in edges):
            gone.add(k)
    assert {x.k for x in turned_away(df, ["g"]).collect()} == gone


def test_conversation_filter_matches_a_loop(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("alpha beta gamma delta lock page index merge".split()) + str(r.randrange(60)) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = r.choice(base).split()
        if r.random() < 0.5:
            words[r.randrange(40)] = f"new{i}"
        rows.append((f"s{i % 2}", i, " ".join(words)))
    rows += [("s0", 100, "short"), ("s0", 101, None), ("s1", 102, "npm WARN a\nnpm WARN b\nadded 3 packages")]
    df = spark.createDataFrame(rows, "session_id string, block_no long, content string")
    got = {x.block_no: x.reason for x in C.filtered_conversations(df).collect()}
    kept: dict[str, list[set]] = {"s0": [], "s1": []}
    for s, i, t in rows[:60]:
        w = set(t.split())
        dup = any(len(w & k) / len(w | k) >= 0.95 for k in kept[s])
        assert (got[i] == "near_duplicate") == dup
        if not dup:
            kept[s].append(w)
    assert got[100] == "below_min_length" and got[102] == "cli_output" and 101 not in got


def test_recovery_states(spark):
    ledger = spark.createDataFrame([("b1", "pending", "n", "x"), ("b2", "rolled_back", "n", "q"), ("b3", "pending", "n", "q"), ("b4", "pending", "n", "y")], "batch_id string, status string, namespace string, id string")
    v = spark.createDataFrame([("n", "x"), ("n", "y")], "namespace string, id string")
    k = spark.createDataFrame([("n", "y")], "namespace string, id string")
    assert {r.batch_id: r.state for r in A.recovery(ledger, v, k).collect()} == {"b1": "divergent", "b2": "rolled_back", "b3": "stale", "b4": "clean"}


def test_migration_guard(spark):
    d = docs(spark, [(1, "a", "x", "t", None, 0, None, None, None), (2, "b", "y", "t", None, 0, None, None, None)])
    with pytest.raises(ValueError):
        A.migrated(d, "x", "y")
    assert {r.namespace for r in A.migrated(d, "x", "z", delete_source=True).collect()} == {"y", "z"}


def test_paths_and_tokens():
    for bad in ("../x", "a/../b", "./x", "a\0b", "a\nb", ""):
        with pytest.raises(ValueError):
            files.checked_path(bad)
    with pytest.raises(ValueError):
        files.checked_path("/etc/passwd", ("/data",))
    assert files.checked_path("/data/x", ("/data",)) == "/data/x"
    assert S.allowed("n", None, {}) and not S.allowed("n", None, {"n": "t"}) and S.allowed("n", "t", {"n": "t"}) and S.allowed("n", None, {"n": "t"}, enabled=False)


def test_export_lines_keep_going(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "a", "metadata": {"k": 1}}\n\n{broken\n{"id": "2"}\n{"id": "3", "text": "b", "embeddings": [1, 2.5]}\n')
    good, bad = files.export_lines(spark, str(tmp_path / "x.jsonl"))
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {"1", "3"} and rows["1"].metadata == '{"k":1}' and rows["3"].embeddings == [1.0, 2.5] and bad.count() == 2


def test_listing_depth_and_endings(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("x")
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.collect()}
    assert names(files.listing(spark, str(tmp_path), indexable=True)) == {"a.md", "c.md"}
    assert names(files.listing(spark, str(tmp_path), recursive=False, indexable=True)) == {"a.md"}


def test_ingest_is_idempotent(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    df = spark.createDataFrame([(1, "x" * 60), (2, "x" * 60), (3, "short"), (4, None)], "n long, text string")
    df.write.parquet(src)
    ingest(spark, src, df.schema, out, mark)
    spark.createDataFrame([(5, "x" * 60), (6, "y" * 60)], "n long, text string").write.mode("append").parquet(src)
    ingest(spark, src, df.schema, out, mark)
    assert {r.n for r in spark.read.parquet(out).collect()} == {1, 6}


def test_hashed_embedding_is_unit_length(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "alpha beta")], "i int, text string")
    v = {r.i: r.vector for r in E.embedded(d, ["i"]).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and v[1] == v[4] and v[3] is None and not any(v[2])


def test_long_texts_are_embedded_whole(spark, monkeypatch):
    long = "alpha beta. " * 3_500 + "omega " * 1_000  # 48,000 characters
    d = spark.createDataFrame([(1, long), (2, None), (3, "")], "i int, text string")
    v = {r.i: r.vector for r in E.embedded(d, ["i"]).collect()}
    assert v[1] == pytest.approx(E.HashedEmbedder().embed([long])[0]) and v[2] is None and not any(v[3])

    class Short:
        most_chars = 20

        def embed(self, texts):
            assert all(len(t) <= 20 for t in texts)
            return [[float(t.count("a")) / len(t), float(len(t))] for t in texts]

    t = "One a. " * 9 + "a" * 50
    assert "".join(E._within(t, 20)) == t
    assert E.embedded(d.limit(0).union(spark.createDataFrame([(1, t)], "i int, text string")), ["i"], make=Short).first().vector[0] == pytest.approx(t.count("a") / len(t))
