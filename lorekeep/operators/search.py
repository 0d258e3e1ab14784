"""Retrieval: exact vector search, BM25, fusion, boosts, deduplication and diversity.

Candidates are found by one pass over the pruned columns with a top-k that
keeps k rows per task (TakeOrderedAndProject); what follows works on candidates
only, at most a few times k rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..functions import vectors as V
from .durable import small
from .parallel import busy
from .store import layer_predicate

K1, B = 1.2, 0.75
VECTOR_WEIGHT, KEYWORD_WEIGHT, RRF_K = 0.6, 0.4, 60
RECENT_DAYS, RECENT_BONUS = 14, 0.12
# Parts of a query that ask for details, and multipliers of the layers 1 to 4.
DETAIL_WORDS = ("why", "how", "details", "detailed", "implementation", "stacktrace", "exact", "quote", "full", "error", "trace")
DETAILED_LAYERS, PLAIN_LAYERS = (0.96, 1.03, 1.08, 1.12), (1.08, 1.04, 1.0, 0.96)


def terms_of(query: str) -> list[str]:
    """Different terms of a query, in order, by the same rules as those of texts."""
    found = [t for t in re.findall(r"[^\W_]+", query.lower()) if len(t.encode()) < 40]
    return list(dict.fromkeys(found))


def escaped(query: str) -> str:
    """The query with the special characters of a query language behind backslashes, for engines that parse queries."""
    return re.sub(r"""([+\-&|!(){}\[\]^"~*?:\\/<>=])""", r"\\\1", query)


def term_array(text) -> Column:
    """Lower-case alphanumeric runs of fewer than 40 bytes."""
    return F.filter(X.alnum_runs(F.lower(X.col(text))), lambda t: F.octet_length(t) < 40)


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def vector_top(df: DataFrame, query: list[float], k: int, layer: int | None = None, dim: int = 64, key: str = "row_no") -> DataFrame:
    """The k nearest rows by L2 among rows with a usable vector: key and dist, nearest first."""
    keep = (key,) if layer is None else (key, "layer")
    return nearest(features(df, None, query, dim, keep=keep), k, layer, key)


def features(df: DataFrame, query: str | None, vector: list[float] | None, dim: int = 64, text: str = "text", keep: tuple[str, ...] = ("row_no", "namespace", "id", "layer")) -> DataFrame:
    """`keep` and a few numbers per row: dist to the vector (null if unusable), and _n and _f0.. of the query's terms.

    Texts and vectors end here, before anything is shuffled; choosing the first
    row of each key, counting and ranking work on these numbers.
    """
    cols: list[Column] = [F.col(c) for c in keep]
    if vector is not None:
        cols.append(F.when(V.usable("vector", dim), V.l2(V.doubles("vector"), V.literal(vector))).alias("dist"))
    if query is not None:
        used = [text, *(["vector"] if vector is not None else [])]
        df = busy(df.select(*dict.fromkeys([*keep, *used]))).withColumn("_terms", term_array(text))  # made once per row, in a projection of its own
        cols += [F.size("_terms").alias("_n"), *[_occurrences("_terms", t).alias(f"_f{i}") for i, t in enumerate(terms_of(query))]]
        cols.append(F.col(text).isNotNull().alias("_has"))
    return df.select(*cols)


def nearest(feats: DataFrame, k: int, layer: int | None = None, key: str = "row_no") -> DataFrame:
    """The k nearest rows of `features`: key and dist, nearest first."""
    near = feats.where(F.col("dist").isNotNull() & layer_predicate(layer)) if layer is not None else feats.where(F.col("dist").isNotNull())
    return near.select(key, "dist").orderBy("dist", key).limit(k)


def keyword_scores(feats: DataFrame, terms: int, key: str = "row_no") -> DataFrame:
    """key and BM25 score of the rows of `features` with text, null for those without a term; statistics are those of all these rows.

    Rows without a term are not filtered here: the filter would be pushed below
    the projections and make the terms of every text once per query term.
    """
    if not terms:
        return feats.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    counts = feats.where("_has")
    stats = counts.agg(F.count("*").alias("rows"), F.avg("_n").alias("mean"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(terms)]).first()  # one row
    score = bm25_expression(stats["rows"], stats["mean"], [stats[f"d{i}"] for i in range(terms)])
    hit = F.greatest(F.lit(0), *[F.col(f"_f{i}") for i in range(terms)])
    return counts.select(key, F.when(hit > 0, score).alias("score"))


def bm25_expression(rows: int, mean: float | None, having: list[int | None]) -> Column:
    """The BM25 score from the columns _n and _f0.., given the number of rows, their mean length and the rows that have each term."""
    score = F.lit(0.0)
    for i, n in enumerate(having):
        tf = F.col(f"_f{i}").cast("double")
        score = score + _idf(rows, n or 0) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.lit(mean or 1.0)))
    return score


def best(scores: DataFrame, k: int, key: str = "row_no") -> DataFrame:
    """The k best rows that have a score."""
    return scores.orderBy(F.desc_nulls_last("score"), key).limit(k).where(F.col("score").isNotNull())


def _idf(rows: int, having: int) -> float:
    return math.log(1 + (rows - having + 0.5) / (having + 0.5))


def bm25_scores(df: DataFrame, query: str, key: str = "row_no", text: str = "text") -> DataFrame:
    """key and score of every row with text, null without a term of the query; statistics are those of all rows of `df`.

    One pass counts rows, lengths and document frequencies, a second scores;
    rows are not shuffled.
    """
    return keyword_scores(features(df, query, None, text=text, keep=(key,)), len(terms_of(query)), key)


def bm25_top(df: DataFrame, query: str, k: int, namespace: str | None = None, key: str = "row_no", scores: DataFrame | None = None) -> DataFrame:
    """The k best rows; with a namespace, those of the best 2k rows that lie in it, at most k."""
    hits = best(bm25_scores(df, query, key) if scores is None else scores, 2 * k, key)
    if namespace is not None:
        hits = hits.join(df.select(key, "namespace"), key).where(F.col("namespace") == namespace).select(key, "score")
    return best(hits, k, key)


def postings(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    """(key, term, tf): the derived keyword index."""
    return df.select(key, F.explode(term_array(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fused(vector: DataFrame, keyword: DataFrame, key: str = "row_no", rrf: bool = False) -> DataFrame:
    """Weighted linear fusion, or reciprocal ranks: key, vector_score, keyword_score, score of rows on either side."""
    v = _ranked(vector, "dist", key)
    b = _ranked(keyword, F.desc("score"), key)
    if rrf:
        v = v.select(key, (F.lit(VECTOR_WEIGHT) / (RRF_K + F.col("_rank") + 1)).alias("vector_score"))
        b = b.select(key, (F.lit(KEYWORD_WEIGHT) / (RRF_K + F.col("_rank") + 1)).alias("keyword_score"))
        total = F.coalesce("vector_score", F.lit(0.0)) + F.coalesce("keyword_score", F.lit(0.0))
    else:
        everything = Window.partitionBy()
        v = v.select(key, (1 - F.col("_rank") / F.count("*").over(everything)).alias("vector_score"))
        b = b.select(key, (F.col("score") / F.max("score").over(everything)).alias("keyword_score"))
        total = VECTOR_WEIGHT * F.coalesce("vector_score", F.lit(0.0)) + KEYWORD_WEIGHT * F.coalesce("keyword_score", F.lit(0.0))
    return v.join(b, key, "full_outer").withColumn("score", total)


def left_fused(vector: DataFrame, keyword: DataFrame, k: int, key: str = "row_no") -> DataFrame:
    """The older fusion: vector hits keep their place score, raised by the keyword score where there is one; other keyword hits are dropped."""
    v = _ranked(vector, "dist", key).select(key, (1 - F.col("_rank") / (k + 1)).alias("vector_score"))
    b = keyword.select(key, (F.col("score") / F.max("score").over(Window.partitionBy())).alias("keyword_score"))
    return v.join(b, key, "left").withColumn("score", VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.coalesce("keyword_score", F.lit(0.0)))


def is_detailed(query: str) -> bool:
    low = "".join(c.lower() if c.isascii() else c for c in query)
    return len(low.split()) >= 8 or any(w in low for w in DETAIL_WORDS)


def layer_factor(query: str) -> Column:
    factors = DETAILED_LAYERS if is_detailed(query) else PLAIN_LAYERS
    out = F.lit(1.0)
    for i, f in enumerate(factors, 1):
        out = F.when(F.col("layer") == i, F.lit(f)).otherwise(out)
    return out


def recency_bonus(now: str, metadata="metadata") -> Column:
    """Up to 0.12 for rows of the last 14 days before `now`, falling in a line to 0."""
    age = F.lit(now).cast("timestamp").cast("long") - M.first_time(M.parsed(metadata)).cast("long")
    window = RECENT_DAYS * 86400
    return F.when(age.between(0, window), RECENT_BONUS * (window - age) / window).otherwise(F.lit(0.0))


@dataclass
class Options:
    k: int = 10
    layer: int | None = 1
    project: str | None = None
    max_per_source: int = 3
    rrf: bool = False
    now: str = "2026-10-15 00:00:00"
    dim: int = 64

    @property
    def candidates(self) -> int:
        """Candidates fetched per wanted row; a project filter leaves few of them."""
        return self.k * (8 if self.project else 3)


def first_per(df: DataFrame, group: Column, order: list, most: int = 1) -> DataFrame:
    return df.withColumn("_g", group).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_n") <= most).drop("_g", "_n")


def finished(hits: DataFrame, query: str, o: Options, key: str = "row_no") -> DataFrame:
    """Project filter, boosts, one row per content hash, one per source, at most a few per path, the best k."""
    v = M.parsed()
    if o.project:
        hits = hits.where(M.in_project(v, o.project))
    hits = hits.withColumn("score", F.col("score") * layer_factor(query) + recency_bonus(o.now))
    order = [F.desc("score"), key]
    own = F.concat_ws("::", F.col("namespace"), F.col("id"))
    hits = first_per(hits, F.coalesce(F.concat(F.lit("h:"), M.text_value(v, "content_hash")), F.concat(F.lit("r:"), F.col(key).cast("string"))), order)
    hits = first_per(hits, F.coalesce(M.text_value(v, "source_path"), M.text_value(v, "path"), own), order)
    if o.max_per_source:
        hits = first_per(hits, F.coalesce(M.text_value(v, "path"), F.lit("unknown")), order, o.max_per_source)
    return hits.orderBy(*order).limit(o.k)


def _fetched(df: DataFrame, hits: DataFrame, key: str, *more: str) -> DataFrame:
    """Candidates, at most a few times k, with the columns that the later steps need."""
    return F.broadcast(hits).join(df.select(key, "id", "namespace", "metadata", "layer", *more), key)


def best_keywords(feats: DataFrame, query: str, k: int, key: str = "row_no") -> DataFrame:
    return best(keyword_scores(feats, len(terms_of(query)), key), k, key)


# The modes take the store, for what is fetched of candidates, the features of the rows that count, and the scores of rows
# by keywords where an index has them; else they are made from the features.
def vector_mode(df: DataFrame, feats: DataFrame, query: str, o: Options, key: str = "row_no") -> DataFrame:
    """All vector candidates weigh 1 before boosts."""
    hits = nearest(feats, o.candidates, o.layer, key).select(key, F.lit(1.0).alias("score"))
    return finished(_fetched(df, hits, key), query, o, key)


def keyword_mode(df: DataFrame, feats: DataFrame | None, query: str, o: Options, key: str = "row_no", scores: DataFrame | None = None) -> DataFrame:
    """Keyword candidates of any layer."""
    hits = best_keywords(feats, query, o.candidates, key) if scores is None else best(scores, o.candidates, key)
    return finished(_fetched(df, hits, key), query, o, key)


def hybrid_mode(df: DataFrame, feats: DataFrame, query: str, o: Options, key: str = "row_no", scores: DataFrame | None = None) -> DataFrame:
    """Vector and keyword candidates fused; a row found by keywords alone must be of the wanted layer itself."""
    v, b = nearest(feats, o.candidates, o.layer, key), best_keywords(feats, query, 2 * o.candidates, key) if scores is None else best(scores, 2 * o.candidates, key)
    hits = fused(v, b, key, o.rrf).orderBy(F.desc("score"), key).limit(2 * o.candidates)
    rows = _fetched(df, hits, key)
    if o.layer is not None:
        rows = rows.where(F.col("vector_score").isNotNull() | (F.col("layer") == o.layer))
    return finished(rows, query, o, key)


def search(df: DataFrame, feats: DataFrame, query: str, o: Options, mode: str = "hybrid", key: str = "row_no") -> DataFrame:
    """The mode asked for: vector, bm25 or hybrid."""
    return {"vector": vector_mode, "bm25": keyword_mode, "hybrid": hybrid_mode}[mode](df, feats, query, o, key)


def cosine_rerank(df: DataFrame, feats: DataFrame, query: list[float], o: Options, key: str = "row_no") -> DataFrame:
    """Vector candidates that pass the project filter, ordered by cosine."""
    rows = _fetched(df, nearest(feats, o.candidates, o.layer, key).select(key), key, "vector")
    if o.project:
        rows = rows.where(M.in_project(M.parsed(), o.project))
    return rows.withColumn("score", V.cosine(V.doubles("vector"), V.literal(query))).drop("vector").orderBy(F.desc("score"), key).limit(o.k)


def filtered_search(df: DataFrame, query: list[float], limit: int, key: str = "row_no", dim: int = 64, **filters) -> DataFrame:
    """Place scores over three times the limit, then the metadata filter, then the limit."""
    wide = limit * 3
    near = vector_top(df, query, wide, None, dim, key)
    ranked = _ranked(near, "dist", key).select(key, (1 - F.col("_rank") / (wide + 1)).alias("score"))
    rows = F.broadcast(ranked).join(df.select(key, "metadata"), key)
    return rows.where(M.meta_filter(M.parsed(), **filters)).orderBy(F.desc("score"), key).limit(limit).drop("metadata")


def placed(df: DataFrame, query: list[float], limit: int, key: str = "row_no", dim: int = 64) -> DataFrame:
    """Library search: the nearest rows, scored by their place."""
    return _ranked(vector_top(df, query, limit, None, dim, key), "dist", key).select(key, "dist", (1 - F.col("_rank") / (limit + 1)).alias("score"))


def top_per(df: DataFrame, query: list[float], group: str, k: int, dim: int = 64, key: str = "row_no") -> DataFrame:
    """The k nearest rows of every group, in one pass (tasks keep k rows per group before the shuffle)."""
    near = df.where(V.usable("vector", dim)).select(key, group, V.l2(V.doubles("vector"), V.literal(query)).alias("dist"))
    order = Window.partitionBy(group).orderBy("dist", key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch_bm25(postings: DataFrame, rows: int, mean: float | None, queries: DataFrame, k: int, key: str = "row_no") -> DataFrame:
    """The k best rows of each query (query_id, query) by stored postings (term, key, tf, n) of `rows` rows of `mean` length."""
    q = queries.select("query_id", F.explode(F.array_distinct(term_array("query"))).alias("term"))
    hits = postings.join(small(q.select("term").distinct()), "term", "left_semi")
    freq = hits.groupBy("term").agg(F.count("*").alias("df"))
    tf, total = F.col("tf").cast("double"), F.lit(rows)
    part = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
    sums = hits.join(freq, "term").join(small(q), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
