"""Retrieval queries: vectors, BM25, hybrid modes, fusion, ranking and routing (L, R, W, T22-T26)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..functions import vectors as V
from ..operators import search as Q
from ..operators.durable import shared_folder
from ..operators.keywords import KeywordIndex
from ..operators import store as S
from ..operators.router import routed
from ..sources import table
from ..sources.versions import Files
from .registry import Registry, first_time, pieces, text_value, usable

R = Registry()
QUERY = "stale parser checkpoint of the vector index"
NOW = "2026-10-15 00:00:00"
PROJECT = "lonyarond"


def docs(spark, base, *cols):
    return table(spark, base, "mcp_documents", *cols)


def corpus(spark, base, query=None, vector=None):
    """The features of the first written row of every key; only they are shuffled, not texts or vectors."""
    feats = Q.features(docs(spark, base), query, vector)
    return S.first_written(feats, *[c for c in feats.columns if c not in ("row_no", "namespace", "id")])


def query_vector(spark, base) -> list[float]:
    """The vector of the first row that has a usable one, as the query."""
    d = docs(spark, base, "row_no", "vector").where(V.usable("vector", 64))
    row = d.agg(F.min_by("vector", "row_no")).first()
    return [float(x) for x in row[0]] if row and row[0] else [1.0] + [0.0] * 63


def keyword_index(spark, base) -> KeywordIndex:
    """The keyword index of the store, made once an application as long as the file stays the same."""
    path = f"{base}/mcp_documents.parquet"
    state = Files(spark, path).state(path)
    made = spark.sparkContext.__dict__.setdefault("_lorekeep_indexes", {})
    if state not in made or not made[state].rows.files.exists(made[state].rows.folder):
        index = KeywordIndex(spark, f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}")
        index.add(docs(spark, base, "row_no", "namespace", "id", "text"), "store")
        made[state] = index
    return made[state]


# ---- parts of SQL ------------------------------------------------------------
QV = f"(SELECT arg_min(vector::DOUBLE[], row_no) FROM mcp_documents WHERE {usable()})"
LIVE = "live AS (SELECT * FROM mcp_documents WHERE namespace <> '' AND id <> '' QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY row_no) = 1)"


def sql_near(src: str, k: int, layer: str = "true") -> str:
    return f"(SELECT row_no, list_distance(vector::DOUBLE[], {QV}) AS dist FROM {src} WHERE {layer} AND {usable()} ORDER BY dist, row_no LIMIT {k})"


_TERMS = "(VALUES " + ", ".join(f"('{t}')" for t in Q.terms_of(QUERY)) + ") q(term)"


def sql_bm25(src: str) -> str:
    return f"""tok AS (SELECT row_no, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) < 40) AS t FROM {src} WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS m FROM tok),
tf AS (SELECT row_no, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM tok, {_TERMS}),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1),
bm AS (SELECT row_no, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)) ELSE 0 END) AS score FROM tf JOIN df USING (term), st GROUP BY row_no HAVING sum(tf) > 0)"""


_LAYER = "CASE layer WHEN 1 THEN 1.08 WHEN 2 THEN 1.04 WHEN 3 THEN 1.0 WHEN 4 THEN 0.96 ELSE 1.0 END"
_AGE = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch(ft)))"
_RECENT = f"CASE WHEN {_AGE} BETWEEN 0 AND 1209600 THEN 0.12 * (1209600 - {_AGE}) / 1209600 ELSE 0 END"


def sql_finish(hits: str, k: int) -> str:
    """Boosts, one per hash, one per source, three per path, the best k; `hits` has row_no and score."""
    return f"""rowsx AS (SELECT h.row_no, h.score, d.namespace, d.id, d.layer, d.metadata, {first_time()} AS ft FROM ({hits}) h JOIN live d USING (row_no)),
b AS (SELECT row_no, namespace, id, metadata, score * {_LAYER} + {_RECENT} AS score FROM rowsx),
d1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY coalesce('h:' || ({text_value('content_hash')}), 'r:' || row_no) ORDER BY score DESC, row_no) = 1),
d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY coalesce({text_value('source_path')}, {text_value('path')}, namespace || '::' || id) ORDER BY score DESC, row_no) = 1),
d3 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY coalesce({text_value('path')}, 'unknown') ORDER BY score DESC, row_no) <= 3)
SELECT row_no, namespace, id, round(score, 6) AS score FROM d3 ORDER BY score DESC, row_no LIMIT {k}"""


def out(df, *extra):
    return df.select("row_no", "namespace", "id", F.round("score", 6).alias("score"), *extra)


# ---- vectors -------------------------------------------------------------------
@R.add("l1_vector_topk", f"SELECT row_no, round(dist, 6) AS dist FROM {sql_near('mcp_documents', 20)}")
def _(spark, base):
    return Q.vector_top(docs(spark, base, "row_no", "vector"), query_vector(spark, base), 20).select("row_no", F.round("dist", 6).alias("dist"))


@R.add("l2_vector_topk_layer", f"SELECT row_no, round(dist, 6) AS dist FROM {sql_near('mcp_documents', 20, 'layer IN (0, 1)')}")
def _(spark, base):
    return Q.vector_top(docs(spark, base, "row_no", "vector", "layer"), query_vector(spark, base), 20, 1).select("row_no", F.round("dist", 6).alias("dist"))


@R.add("l3_candidates", f"SELECT row_no, row_number() OVER (ORDER BY dist, row_no) AS place FROM {sql_near('mcp_documents', 80, 'layer IN (0, 1)')}")
def _(spark, base):
    o = Q.Options(project=PROJECT)
    near = Q.vector_top(docs(spark, base, "row_no", "vector", "layer"), query_vector(spark, base), o.candidates, 1)
    return near.select("row_no", F.row_number().over(Window.orderBy("dist", "row_no")).cast("long").alias("place"))


@R.add("l7_cosine_rerank", f"""WITH {LIVE}, c AS {sql_near('live', 30, 'layer IN (0, 1)')}
SELECT row_no, namespace, id, round(list_cosine_similarity(vector::DOUBLE[], {QV}), 6) AS score FROM c JOIN live USING (row_no) ORDER BY list_cosine_similarity(vector::DOUBLE[], {QV}) DESC, row_no LIMIT 10""")
def _(spark, base):
    q = query_vector(spark, base)
    return out(Q.cosine_rerank(docs(spark, base), corpus(spark, base, None, q), q, Q.Options()))


_PROJECTS = [f"lower({text_value(k)})" for k in ("project", "project_id", "source_project")]


@R.add("r2_vector_search_project", f"""WITH {LIVE}, c AS {sql_near('live', 80, 'layer IN (0, 1)')}, p AS (SELECT coalesce({', '.join(_PROJECTS)}) AS p FROM c JOIN live USING (row_no) WHERE p IS NOT NULL ORDER BY dist, row_no LIMIT 1)
SELECT row_no, namespace, id, round(list_cosine_similarity(vector::DOUBLE[], {QV}), 6) AS score FROM c JOIN live USING (row_no) WHERE {" OR ".join(f"coalesce({x} = (SELECT p FROM p), false)" for x in _PROJECTS)}
ORDER BY list_cosine_similarity(vector::DOUBLE[], {QV}) DESC, row_no LIMIT 10""")
def _(spark, base):
    d, q = docs(spark, base), query_vector(spark, base)
    c, v = corpus(spark, base, None, q), M.parsed()
    named = d.select("row_no", F.coalesce(*[M.text_value(v, k) for k in ("project", "project_id", "source_project")]).alias("p"))
    first = F.broadcast(Q.nearest(c, 80, 1)).join(named, "row_no").where("p is not null").orderBy("dist", "row_no").first()
    return out(Q.cosine_rerank(d, c, q, Q.Options(project=first.p if first else "none")))


@R.add("r15_library_search", f"SELECT row_no, round(dist, 6) AS dist, round(1 - (row_number() OVER (ORDER BY dist, row_no) - 1) / 21.0, 6) AS score FROM {sql_near('mcp_documents', 20)}")
def _(spark, base):
    return Q.placed(docs(spark, base, "row_no", "vector"), query_vector(spark, base), 20).select("row_no", F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))


@R.add("r16_filtered_search", f"""SELECT row_no, round(score, 6) AS score FROM (SELECT row_no, 1 - (row_number() OVER (ORDER BY dist, row_no) - 1) / 61.0 AS score FROM {sql_near('mcp_documents', 60)}) JOIN mcp_documents USING (row_no)
WHERE coalesce({text_value('type')} = 'note', false) ORDER BY score DESC, row_no LIMIT 20""")
def _(spark, base):
    return Q.filtered_search(docs(spark, base, "row_no", "vector", "metadata"), query_vector(spark, base), 20, equals={"type": "note"}).select("row_no", F.round("score", 6).alias("score"))


@R.add("r20_cross_search", f"""WITH p AS (SELECT row_no, namespace, list_distance(vector::DOUBLE[], {QV}) AS dist FROM mcp_documents WHERE {usable()} QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY dist, row_no) <= 10)
SELECT row_no, namespace, round(dist, 6) AS dist FROM p ORDER BY p.dist, row_no LIMIT 50""")
def _(spark, base):
    per = Q.top_per(docs(spark, base, "row_no", "namespace", "vector"), query_vector(spark, base), "namespace", 10)
    return per.orderBy("dist", "row_no").limit(50).select("row_no", "namespace", F.round("dist", 6).alias("dist"))


@R.add("w11_topk_per_namespace", f"""SELECT namespace, row_no, row_number() OVER (PARTITION BY namespace ORDER BY list_distance(vector::DOUBLE[], {QV}), row_no) AS place FROM mcp_documents WHERE {usable()} QUALIFY place <= 5""")
def _(spark, base):
    per = Q.top_per(docs(spark, base, "row_no", "namespace", "vector"), query_vector(spark, base), "namespace", 5)
    return per.select("namespace", "row_no", F.col("rank").cast("long").alias("place"))


@R.add("r21_dive_by_layer", f"""SELECT layer, row_no, row_number() OVER (PARTITION BY layer ORDER BY list_distance(vector::DOUBLE[], {QV}), row_no) AS place FROM mcp_documents WHERE {usable()} QUALIFY place <= 5""")
def _(spark, base):
    per = Q.top_per(docs(spark, base, "row_no", "layer", "vector"), query_vector(spark, base), "layer", 5)
    return per.select("layer", "row_no", F.col("rank").cast("long").alias("place"))


@R.add("a11_layer_stats", f"""WITH p AS (SELECT layer, list_cosine_similarity(vector::DOUBLE[], {QV}) AS s, list_distance(vector::DOUBLE[], {QV}) AS dist, row_no FROM mcp_documents WHERE {usable()} QUALIFY row_number() OVER (PARTITION BY layer ORDER BY dist, row_no) <= 50)
SELECT layer, count(*) AS n, round(avg(dist), 6) AS mean_dist FROM p GROUP BY 1""")
def _(spark, base):
    per = Q.top_per(docs(spark, base, "row_no", "layer", "vector"), query_vector(spark, base), "layer", 50)
    return per.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean_dist"))


@R.add("r22_recall_sources", f"""WITH p AS (SELECT row_no, namespace, list_distance(vector::DOUBLE[], {QV}) AS dist, coalesce({text_value('path')}, 'unknown') AS source, substr(coalesce({text_value('indexed_at')}, 'unknown'), 1, 10) AS day FROM mcp_documents WHERE layer IN (0, 1) AND {usable()} QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY dist, row_no) <= 10),
t AS (SELECT * FROM p ORDER BY dist, row_no LIMIT 50)
SELECT source, day, count(*) AS hits, round(min(dist), 6) AS best FROM t GROUP BY 1, 2""")
def _(spark, base):
    d = docs(spark, base, "row_no", "namespace", "layer", "vector", "metadata").where(S.layer_predicate(1))
    per = Q.top_per(d, query_vector(spark, base), "namespace", 10).orderBy("dist", "row_no").limit(50)
    v = M.parsed()
    named = F.broadcast(per.select("row_no", "dist")).join(d.select("row_no", "metadata"), "row_no")
    day = F.substring(F.coalesce(M.text_value(v, "indexed_at"), F.lit("unknown")), 1, 10)
    return named.groupBy(F.coalesce(M.text_value(v, "path"), F.lit("unknown")).alias("source"), day.alias("day")).agg(F.count("*").alias("hits"), F.round(F.min("dist"), 6).alias("best"))


# ---- keywords ------------------------------------------------------------------
@R.add("r1_bm25_search", f"WITH {sql_bm25('mcp_documents')} SELECT row_no, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, row_no LIMIT 20")
def _(spark, base):
    return Q.best(keyword_index(spark, base).scores(QUERY), 20).select("row_no", F.round("score", 6).alias("score"))


@R.add("l5_bm25_namespace", f"""WITH {sql_bm25('mcp_documents')}, t AS (SELECT row_no, score FROM bm ORDER BY score DESC, row_no LIMIT 400)
SELECT row_no, round(t.score, 6) AS score FROM t JOIN mcp_documents USING (row_no) WHERE namespace = 'agent:shared-memory' ORDER BY t.score DESC, row_no LIMIT 200""")
def _(spark, base):
    return Q.bm25_top(docs(spark, base, "row_no", "namespace"), QUERY, 200, "agent:shared-memory", scores=keyword_index(spark, base).scores(QUERY)).select("row_no", F.round("score", 6).alias("score"))


@R.add("a16_bm25_statistics", """WITH tok AS (SELECT row_no, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS t FROM mcp_documents WHERE text IS NOT NULL)
SELECT term, count(DISTINCT row_no) AS df, count(*) AS cf FROM (SELECT row_no, unnest(t) AS term FROM tok) GROUP BY 1""")
def _(spark, base):
    return Q.postings(docs(spark, base, "row_no", "text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@R.add("r1_bm25_batch", """WITH q(query_id, query) AS (VALUES (1, 'merge conflict in the ranking'), (2, 'keyword overlap, twice'), (3, 'Zeile und Ordner'), (4, '')),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM q),
tok AS (SELECT row_no, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS t FROM mcp_documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS m FROM tok),
tf AS (SELECT row_no, len(t) AS dl, x.term, len(list_filter(t, lambda y: y = x.term)) AS tf FROM tok, (SELECT DISTINCT term FROM qt) x),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, row_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st WHERE tf > 0 GROUP BY 1, 2)
SELECT query_id, row_no, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, row_no) <= 10""")
def _(spark, base):
    q = spark.createDataFrame([(1, "merge conflict in the ranking"), (2, "keyword overlap, twice"), (3, "Zeile und Ordner"), (4, "")], "query_id int, query string")
    index = keyword_index(spark, base)
    size = index.rows.read().agg(F.count("*"), F.avg("n")).first()
    return Q.batch_bm25(index.postings.read(), size[0], size[1], q, 10).select("query_id", "row_no", F.round("score", 6).alias("score"))


_LEFT = "(SELECT * FROM mcp_documents WHERE NOT coalesce(namespace = 'agent:shared-memory', false) AND NOT coalesce(namespace = 'kb:venzeleth' AND id = (SELECT min(id) FROM mcp_documents WHERE namespace = 'kb:venzeleth'), false))"


@R.add("k10_keyword_index", f"WITH {sql_bm25(_LEFT)} SELECT row_no, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, row_no LIMIT 50")
def _(spark, base):
    """An index filled by two batches, of which one comes twice; a namespace and an id leave, and it is compacted."""
    d = docs(spark, base, "row_no", "namespace", "id", "text")
    index = KeywordIndex(spark, f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}")
    for batch in (0, 1, 1):
        index.add(d.where(F.col("row_no") % 2 == batch), f"b{batch}")
    index.delete("agent:shared-memory")
    id_ = d.where("namespace = 'kb:venzeleth'").agg(F.min("id")).first()[0]
    index.delete("kb:venzeleth", [id_] if id_ else [])
    index.compact()
    return Q.best(index.scores(QUERY), 50).select("row_no", F.round("score", 6).alias("score"))


# ---- hybrid --------------------------------------------------------------------
_HV = f"hv AS (SELECT row_no, row_number() OVER (ORDER BY dist, row_no) - 1 AS r, count(*) OVER () AS n FROM {sql_near('live', 30, 'layer IN (0, 1)')})"
_HB = "hb AS (SELECT row_no, score, row_number() OVER (ORDER BY score DESC, row_no) - 1 AS r, max(score) OVER () AS m FROM (SELECT * FROM bm ORDER BY score DESC, row_no LIMIT 60))"


@R.add("j4_fusion_weighted", f"""WITH {LIVE}, {sql_bm25('live')}, {_HV}, {_HB}
SELECT row_no, round(1 - hv.r / hv.n, 6) AS vector_score, round(hb.score / hb.m, 6) AS keyword_score, round(0.6 * coalesce(1 - hv.r / hv.n, 0) + 0.4 * coalesce(hb.score / hb.m, 0), 6) AS score FROM hv FULL JOIN hb USING (row_no)""")
def _(spark, base):
    c = corpus(spark, base, None, query_vector(spark, base))
    f = Q.fused(Q.nearest(c, 30, 1), Q.best(keyword_index(spark, base).scores(QUERY, first=True), 60))
    return f.select("row_no", *[F.round(x, 6).alias(x) for x in ("vector_score", "keyword_score", "score")])


@R.add("j5_fusion_left", f"""WITH {sql_bm25('mcp_documents')}, v AS (SELECT row_no, row_number() OVER (ORDER BY dist, row_no) - 1 AS r FROM {sql_near('mcp_documents', 20)}), k AS (SELECT row_no, score, max(score) OVER () AS m FROM (SELECT * FROM bm ORDER BY score DESC, row_no LIMIT 20))
SELECT row_no, round(0.6 * (1 - r / 21.0) + 0.4 * coalesce(k.score / k.m, 0), 6) AS score FROM v LEFT JOIN k USING (row_no)""")
def _(spark, base):
    d = docs(spark, base, "row_no", "vector", "layer")
    return Q.left_fused(Q.vector_top(d, query_vector(spark, base), 20), Q.bm25_top(d, QUERY, 20, scores=keyword_index(spark, base).scores(QUERY)), 20).select("row_no", F.round("score", 6).alias("score"))


_H = f"""WITH {LIVE}, {sql_bm25('live')}, {_HV}, {_HB},
fz AS (SELECT row_no, hv.r AS vr, {{score}} AS score FROM hv FULL JOIN hb USING (row_no)),
ft AS (SELECT * FROM fz ORDER BY score DESC, row_no LIMIT 60), fl AS (SELECT ft.row_no, ft.score FROM ft JOIN live USING (row_no) WHERE vr IS NOT NULL OR layer = 1), """


@R.add("r5_hybrid_weighted", _H.replace("{score}", "0.6 * coalesce(1 - hv.r / hv.n, 0) + 0.4 * coalesce(hb.score / hb.m, 0)") + sql_finish("SELECT * FROM fl", 10))
def hybrid(spark, base):
    return out(Q.hybrid_mode(docs(spark, base), corpus(spark, base, None, query_vector(spark, base)), QUERY, Q.Options(now=NOW), scores=keyword_index(spark, base).scores(QUERY, first=True)))


@R.add("r6b_hybrid_rrf", _H.replace("{score}", "coalesce(0.6 / (60 + hv.r + 1), 0) + coalesce(0.4 / (60 + hb.r + 1), 0)") + sql_finish("SELECT * FROM fl", 10))
def _(spark, base):
    return out(Q.hybrid_mode(docs(spark, base), corpus(spark, base, None, query_vector(spark, base)), QUERY, Q.Options(now=NOW, rrf=True), scores=keyword_index(spark, base).scores(QUERY, first=True)))


@R.add("r3_vector_mode", f"WITH {LIVE}, " + sql_finish(f"SELECT row_no, 1.0 AS score FROM {sql_near('live', 30, 'layer IN (0, 1)')}", 10))
def _(spark, base):
    return out(Q.vector_mode(docs(spark, base), corpus(spark, base, None, query_vector(spark, base)), QUERY, Q.Options(now=NOW)))


@R.add("r4_keyword_mode", f"WITH {LIVE}, {sql_bm25('live')}, " + sql_finish("SELECT row_no, score FROM bm ORDER BY score DESC, row_no LIMIT 30", 10))
def _(spark, base):
    return out(Q.keyword_mode(docs(spark, base), None, QUERY, Q.Options(now=NOW), scores=keyword_index(spark, base).scores(QUERY, first=True)))


@R.add("r17_mode_dispatch", f"WITH {LIVE}, " + sql_finish(f"SELECT row_no, 1.0 AS score FROM {sql_near('live', 30, 'layer IN (0, 1)')}", 10))
def _(spark, base):
    """The routed mode of a meaning query: vector."""
    mode = routed(spark.createDataFrame([("explain a similar concept",)], "query string")).first().mode
    return out(Q.search(docs(spark, base), corpus(spark, base, None, query_vector(spark, base)), QUERY, Q.Options(now=NOW), mode))


@R.add("r10_recency_bonus", f"SELECT row_no, round({_RECENT}, 6) AS bonus FROM (SELECT row_no, {first_time()} AS ft FROM mcp_documents)")
def _(spark, base):
    return docs(spark, base, "row_no", "metadata").select("row_no", F.round(Q.recency_bonus(NOW), 6).alias("bonus"))


@R.add("r8_layer_factor", f"SELECT row_no, {_LAYER}::DOUBLE AS factor FROM mcp_documents")
def _(spark, base):
    return docs(spark, base, "row_no", "layer").select("row_no", Q.layer_factor(QUERY).alias("factor"))


@R.add("r11_times", f"SELECT row_no, floor(epoch({first_time()}))::BIGINT AS seconds FROM mcp_documents")
def _(spark, base):
    return docs(spark, base, "row_no", "metadata").select("row_no", M.first_time(M.parsed()).cast("long").alias("seconds"))


@R.add("r12_dedup_hash", f"""SELECT row_no FROM mcp_documents QUALIFY row_number() OVER (PARTITION BY coalesce('h:' || ({text_value('content_hash')}), 'r:' || row_no) ORDER BY row_no) = 1""")
def _(spark, base):
    d = docs(spark, base, "row_no", "metadata")
    key = F.coalesce(F.concat(F.lit("h:"), M.text_value(M.parsed(), "content_hash")), F.concat(F.lit("r:"), F.col("row_no").cast("string")))
    return d.groupBy(key.alias("k")).agg(F.min("row_no").alias("row_no")).select("row_no")


@R.add("r13_dedup_source", f"""SELECT min(row_no) AS row_no FROM mcp_documents GROUP BY coalesce({text_value('source_path')}, {text_value('path')}, concat_ws('::', namespace, id))""")
def _(spark, base):
    d = docs(spark, base, "row_no", "namespace", "id", "metadata")
    v = M.parsed()
    key = F.coalesce(M.text_value(v, "source_path"), M.text_value(v, "path"), F.concat_ws("::", "namespace", "id"))
    return d.groupBy(key.alias("k")).agg(F.min("row_no").alias("row_no")).select("row_no")


@R.add("r14_source_diversity", f"""SELECT row_no FROM mcp_documents QUALIFY row_number() OVER (PARTITION BY coalesce({text_value('path')}, 'unknown') ORDER BY row_no) <= 3""")
def _(spark, base):
    d = docs(spark, base, "row_no", "metadata").select("row_no", F.coalesce(M.text_value(M.parsed(), "path"), F.lit("unknown")).alias("p"))
    # the window keeps three rows per path in each task before the shuffle (WindowGroupLimit)
    return d.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("row_no"))).where("n <= 3").select("row_no")


@R.add("r30_browse", "SELECT row_no, id, namespace, substr(text, 1, 200) AS preview, 0.0::DOUBLE AS score FROM mcp_documents ORDER BY row_no LIMIT 50 OFFSET 50")
def _(spark, base):
    return S.page(docs(spark, base, "row_no", "id", "namespace", "text"), 50, 50).select("row_no", "id", "namespace", F.substring("text", 1, 200).alias("preview"), F.lit(0.0).alias("score"))


# ---- vector functions ------------------------------------------------------------
_UNIT = "CASE WHEN sqrt(list_dot_product({v}, {v})) > 1e-10 THEN list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"


def _listed(col):
    return F.array_join(F.transform(col, lambda x: F.format_number(x, 4)), " ")


def _sql_listed(v):
    return f"array_to_string(list_transform({v}, lambda x: format('{{:.4f}}', x)), ' ')"


@R.add("t23_unit_vectors", f"SELECT vec_id, {_sql_listed('(' + _UNIT.format(v='e') + ')')} AS listed FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(spark, base):
    return table(spark, base, "embeddings").select("vec_id", _listed(V.unit(V.doubles("embedding"))).alias("listed"))


_EXP = "list_concat(e, list_transform(range(32), lambda x: 0.0::DOUBLE))"


@R.add("t24_expanded", f"SELECT vec_id, 96 AS size, {_sql_listed('(' + _UNIT.format(v='e') + ')')} AS listed FROM (SELECT vec_id, {_EXP} AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def _(spark, base):
    x = table(spark, base, "embeddings").select("vec_id", V.expanded(V.doubles("embedding"), 96).alias("e"))
    return x.select("vec_id", F.size("e").alias("size"), _listed("e").alias("listed"))


@R.add("t25_contracted", f"SELECT vec_id, 16 AS size, {_sql_listed('(' + _UNIT.format(v='e') + ')')} AS listed FROM (SELECT vec_id, list_transform(range(16), lambda i: list_avg(e[i * 4 + 1 : i * 4 + 4])) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def _(spark, base):
    x = table(spark, base, "embeddings").select("vec_id", V.contracted(V.doubles("embedding"), 16, 64).alias("e"))
    return x.select("vec_id", F.size("e").alias("size"), _listed("e").alias("listed"))


@R.add("t26_adapted", f"SELECT vec_id, 48 AS size, {_sql_listed('(' + _UNIT.format(v='e') + ')')} AS listed FROM (SELECT vec_id, (embedding::DOUBLE[])[1:48] AS e FROM embeddings)")
def _(spark, base):
    x = table(spark, base, "embeddings").select("vec_id", V.adapted(V.doubles("embedding"), 48, 64).alias("e"))
    return x.select("vec_id", F.size("e").alias("size"), _listed("e").alias("listed"))


@R.add("t22_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM embeddings")
def _(spark, base):
    e = table(spark, base, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return e.select("vec_id", F.round(V.cosine(V.doubles("embedding"), V.literal(q)), 6).alias("cosine"))


# ---- routing -----------------------------------------------------------------------
QUERIES = [
    "when did we merge the parser", "who imports router.rs", "where is SliceLayer defined", "explain the concept of layers", '"exact words" please', "latest index of 2025",
    "plain words only", "what depends on module store", "2024-05-06 backup", "similar topic about memory", "use file class", "kiedy wczoraj", "", "IMPORTS What imports Engine", "how to call the function since last week", "it's here", "recent changes about the date of use",
]
_QL = "(VALUES " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(QUERIES)) + ") v(query_id, query)"


def _words_in(words):
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


def _sql_route() -> str:
    from ..operators import router as O

    has = lambda xs: "(" + " OR ".join(f"contains(lo, '{x}')" for x in xs) + ")"
    case = lambda at: "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[at]!r}" for k, v in O.MODES.items()) + " END"
    return rf"""WITH a AS (SELECT query_id, query, lower(query) AS lo, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS ow FROM {_QL}),
b AS (SELECT *, {_words_in(O.TEMPORAL)} AS t, {_words_in(O.STRUCTURAL)} AS s, {_words_in(O.SEMANTIC)} AS m, greatest(len(w), 1)::DOUBLE AS n FROM a),
c AS (SELECT *, CASE WHEN contains(query, '"') OR contains(query, '''') THEN 'exact' WHEN t > 0 OR {has(O.YEARS)} OR (length(regexp_replace(lo, '[^-]', '', 'g')) >= 2 AND length(regexp_replace(lo, '[^0-9]', '', 'g')) >= 4) THEN 'temporal'
 WHEN s >= 2 OR (s > 0 AND (contains(lo, 'who ') OR contains(lo, 'what '))) THEN 'structural' WHEN m > 0 THEN 'semantic' ELSE 'hybrid' END AS intent FROM b),
d AS (SELECT *, intent <> 'temporal' AND t / n >= 0.3 AS also_t, intent <> 'structural' AND s / n >= 0.4 AS also_s FROM c)
SELECT query_id, intent, round(CASE intent WHEN 'temporal' THEN least(t / n * 2 + 0.3, 1) WHEN 'structural' THEN least(s / n * 2 + 0.3, 1) WHEN 'semantic' THEN least(m / n * 2 + 0.3, 1) WHEN 'exact' THEN 0.9 ELSE 0.5 END, 6)::DOUBLE AS confidence,
 concat_ws(',', CASE WHEN also_t THEN 'temporal' END, CASE WHEN also_s THEN 'structural' END) AS secondary,
 CASE WHEN intent = 'structural' THEN CASE WHEN contains(lo, 'who imports') OR contains(lo, 'what imports') THEN 'who-imports ' || coalesce(ow[list_position(list_transform(ow, lambda x: lower(x)), 'imports') + 1], 'TARGET')
  WHEN contains(lo, 'where') AND contains(lo, 'defined') THEN 'find ' || coalesce(list_filter(ow, lambda x: lower(x) NOT IN ('where', 'is', 'the', 'defined', 'definition', 'of'))[1], 'SYMBOL') WHEN contains(lo, 'depend') THEN 'impact' ELSE 'overview' END END AS command,
 CASE WHEN intent = 'temporal' OR also_t THEN array_to_string(list_filter(['2023', '2024', '2025', 'yesterday', 'today', 'last week', 'last month', 'ago'], lambda x: contains(lo, x)), ',') END AS date_refs,
 CASE WHEN intent = 'temporal' OR also_t THEN {has(O.RECENT)} END AS prefer_recent, {case(0)} AS mode, ({case(1)})::DOUBLE AS keyword_weight, ({case(2)})::DOUBLE AS vector_weight, {case(3)} AS boost_exact FROM d"""


@R.add("r26_route_queries", _sql_route())
def _(spark, base):
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    return routed(q).drop("query").withColumn("confidence", F.round("confidence", 6))


@R.add("r25_intents_of_texts", """WITH """ + _sql_route().split("WITH ", 1)[1].replace(_QL, "(SELECT item_id AS query_id, text AS query FROM eval_items)").split("SELECT query_id, intent, round", 1)[0] + """SELECT intent, count(*) AS n FROM d GROUP BY 1""")
def _(spark, base):
    return routed(table(spark, base, "eval_items", F.col("text").alias("query"))).groupBy("intent").agg(F.count("*").alias("n"))


@R.add("r9_detailed_queries", f"""SELECT query_id, len(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) >= 8 OR regexp_matches(lower(query), '{"|".join(Q.DETAIL_WORDS)}') AS detailed FROM {_QL}""")
def _(spark, base):
    return spark.createDataFrame([(i, Q.is_detailed(q)) for i, q in enumerate(QUERIES)], "query_id int, detailed boolean")


@R.add("t5_word_jaccard", f"""SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(wa, wb))) = 0 THEN 1 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 6)::DOUBLE AS similarity FROM
 (SELECT doc_id, list_distinct({pieces('text')}) AS wa FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, list_distinct({pieces('text')}) AS wb FROM documents) b USING (doc_id) WHERE wa IS NOT NULL AND wb IS NOT NULL""")
def _(spark, base):
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(X.word_jaccard("text", "other"), 6).alias("similarity"))
