"""Step-by-step text algorithms and column expressions agree with each other and with their rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import pytext as P
from lorekeep.functions import text as X

TEXTS = ["", " ", "One. Two! Three?", "Dr. Who met Mr. A. B. today. Then left.", "fooBar FooBarBaz x", "a" * 700, "word " * 300, "Zażółć gęślą jaźń. " * 40, "line\n\nnext\n\n\nlast", "会話。会話", "# H1\nbody\n## H2\n\nmore"]
text = st.text(alphabet=st.sampled_from(list("abcAB .!?\n\t0é#")), max_size=300)


def test_expressions_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("t", X.cut_words("t", 50).alias("cut"), X.keyword_tokens("t").alias("tokens"), X.collapse("t").alias("one"), X.fixed_windows("t").alias("w")).collect()
    for r in rows:
        assert r.cut == P.cut_words(r.t, 50)
        assert r.tokens == list(P.keyword_tokens(r.t))
        assert r.one == " ".join(r.t.split())
        assert all(len(x) <= 512 for x in r.w) and (r.t == "" or r.w[-1] == r.t[(len(r.w) - 1) * 384 :][:512])


def test_session_tokens_agree(spark):
    tokens = ["deadbeefdead1", "deadbeefdeadb", "abc123456", "short", "x" * 25, "1a" * 11, "é" * 12]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("s", X.session_like("t"))
    assert {r.t: r.s for r in df.collect()} == {t: P.session_like(t) for t in tokens}


@given(text)
@settings(max_examples=150, deadline=None)
def test_sentences_keep_all_words(t):
    assert "".join(" ".join(P.sentences(t)).split()) == "".join(t.split())


@given(text)
@settings(max_examples=150, deadline=None)
def test_sentence_chunks_cover(t):
    chunks = P.sentence_chunks(t, 60, 100)
    assert chunks
    joined = "".join("".join(chunks).split())
    assert set("".join(t.split())) == set(joined)


def test_abbreviations_do_not_end_sentences():
    assert P.sentences("Dr. Who met Mr. Smith. They left, e.g. early. Plan B. was off.") == ["Dr. Who met Mr. Smith.", "They left, e.g. early.", "Plan B. was off."]


def test_cut_sentence():
    assert P.cut_sentence("One two. Three four five", 12) == "One two."
    assert P.cut_sentence("aaaa bbbb cccc dddd", 12) == "aaaa bbbb"
    assert P.cut_sentence("abc", 12) == "abc"


def test_slices_form_a_chain():
    t = "The parser failed on the first page. The cause was a stale lock in the index. " * 12
    s = P.slices(t, {})
    assert [x["layer"] for x in s] == [1, 2, 3, 4]
    for a, b in zip(s, s[1:], strict=False):
        assert a["parent_id"] == b["id"] and b["children_ids"] == [a["id"]]
    assert s[-1]["parent_id"] is None and s[-1]["content"] == t.strip()
    assert P.size(s[0]["content"]) <= 110
    assert [x["layer"] for x in P.slices(t, {}, fast=True)] == [1, 4]
    assert [x["layer"] for x in P.slices("short", {})] == [4]
    assert [x["layer"] for x in P.slices("short", {"type": "conversation"})] == [1, 4]


def test_conversation_blocks_and_facets():
    t = "User request:\nfix the lock\n\nAssistant response:\nDecision: use a queue. Next: add tests\n"
    b = P.blocks(t, {"type": "conversation", "project": "atlas"})
    assert [x["label"] for x in b] == ["Request", "Response"]
    assert ("Decision", "use a queue.") in b[1]["facets"] and ("Next", "add tests") in b[1]["facets"]
    assert b[0]["facets"][-1][1].startswith("atlas")


def test_sections():
    assert P.sections("# H1\nbody\n## H2\n\nmore") == [("H1", "body"), ("H2", "more")]
    assert P.sections("no head") == [(None, "no head")]


def test_json_texts():
    assert P.json_text({"role": "user", "content": "hi there"}) == "hi there\nuser: hi there"
    assert P.json_text({"name": "n", "observations": ["a", "b"]}) == "n: a; b"
    assert P.json_text({"title": "T", "text": "body"}) == "[T]\nbody"
    assert P.json_kind({"chat_messages": []}) == "conversation" and P.json_kind([]) == "array"


def test_embed_batches():
    assert P.embed_batches([5] * 3, 2, 100) == [0, 0, 1]
    assert P.embed_batches([60, 60, 10], 64, 100) == [0, 1, 1]


def test_keyword_ties_in_order(spark):
    assert P.keywords("beta alpha beta alpha gamma the the", 2) == ["alpha", "beta"]
    assert spark.range(1).select(F.size(X.pieces(F.lit("  a  b ")))).first()[0] == 2


def test_conversation_shapes():
    long = "long enough to be told"
    msgs = [{"role": "human", "sender": "human", "text": long}, {"role": "system", "sender": "x", "text": long}, {"role": "bot", "sender": "bot", "content": [{"text": long}, {"text": "b"}]}, {"role": "user", "sender": "user", "text": "short"}]
    told = [("user", long), ("assistant", long + " b")]
    for value in ({"sessions": [{"info": {"sessionId": "abcdefghij"}, "messages": msgs}]}, {"uuid": "abcdefghij", "messages": msgs}, [{"uuid": "abcdefghij", "chat_messages": msgs}]):
        got = P.conversation_entries(value)
        assert [(e["role"], e["body"]) for e in got] == told and got[0]["session"].endswith("-abcdefgh")
    node = lambda r, t, at: {"message": {"author": {"role": r}, "content": {"parts": [t]}, "create_time": at}}
    got = P.conversation_entries({"id": "x", "mapping": {"a": node("assistant", long + "2", 5.0), "b": node("user", long, 1), "c": {"message": None}, "d": {}}})
    assert [(e["role"], e["body"]) for e in got] == [("user", long), ("assistant", long + "2")]
    assert P.conversation_entries("text") == [] == P.conversation_entries({"messages": "no"})


def test_json_texts_are_whole():
    many = [f"element {i:03}" for i in range(70)]
    assert P.json_text(many).split("\n") == many and P.json_text(many, most_elements=20).split("\n") == many[:20]
    for k in ("messages", "chat_messages"):
        assert P.json_text({k: many}).split("\n") == many and P.json_text({k: many}, most_messages=50).split("\n") == many[:50]
    assert P.json_text({"name": "n", "observations": many}) == "n: " + "; ".join(many)
    assert P.json_text({"messages": [many]}).split("\n") == many
    assert len(P.json_text({"x": "y" * 6000})) == 6008 and len(P.json_text({"x": "y" * 6000}, most_chars=5000)) == 5000
