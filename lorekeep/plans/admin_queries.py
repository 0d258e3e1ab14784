"""Administration queries: quality, overviews, duplicates, timelines, garbage, merging, recovery (A, U, W6, D20-D23, J8, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..operators import admin as A
from ..sources import table
from .registry import Registry, collapse, first_present, strip, text_value, timestamp

R = Registry()
CUTOFF = "2026-01-01 00:00:00"


def docs(spark, base, *cols):
    return table(spark, base, "mcp_documents", *cols)


# ---- quality -------------------------------------------------------------------
def sql_quality(src: str, group: str, text: str) -> str:
    ends = f"length(c) - length(regexp_replace(c, '[.!?]', '', 'g'))"
    return f"""q0 AS (SELECT {group}, coalesce({text}, '') AS c FROM {src}), q1 AS (SELECT *, {ends} AS e, {strip('c')} AS s, strlen(c) AS b FROM q0),
q2 AS (SELECT {group}, count(*) AS chunks, sum(e) AS se, sum(CASE WHEN s = '' THEN 0 WHEN regexp_matches(s, '[.!?:"'')\\]]$') THEN e ELSE greatest(e - 1, 0) END) AS sw,
 avg(CASE WHEN s = '' OR regexp_matches(s, '[!-/:-@\\[-`{{-~]$') THEN 1.0 ELSE 0.0 END) AS word_integrity, avg(CASE WHEN b BETWEEN 200 AND 800 THEN 1.0 ELSE 0.0 END) AS chunk_quality, floor(sum(b) / count(*))::BIGINT AS avg_chunk_length FROM q1 GROUP BY 1),
q3 AS (SELECT *, CASE WHEN se = 0 THEN 1.0 ELSE least(1.0, sw / se) END AS sentence_integrity FROM q2),
q4 AS (SELECT *, 0.5 * sentence_integrity + 0.3 * word_integrity + 0.2 * chunk_quality AS overall FROM q3)"""


_GRADE = "CASE WHEN overall >= 0.95 THEN 'EXCELLENT' WHEN overall >= 0.9 THEN 'GOOD' WHEN overall >= 0.7 THEN 'WARN' ELSE 'PURGE' END"
_Q_OUT = f"chunks, round(sentence_integrity, 6) AS sentence_integrity, round(word_integrity, 6) AS word_integrity, round(chunk_quality, 6) AS chunk_quality, round(overall, 6) AS overall, avg_chunk_length, {_GRADE} AS grade"


def rounded(df, group):
    return df.select(group, "chunks", *[F.round(c, 6).alias(c) for c in ("sentence_integrity", "word_integrity", "chunk_quality", "overall")], "avg_chunk_length", "grade")


@R.add("a7_audit_namespaces", f"WITH {sql_quality('mcp_documents', 'namespace', 'text')} SELECT namespace, {_Q_OUT} FROM q4")
def audit(spark, base):
    return rounded(A.quality(docs(spark, base, "namespace", "text"), "namespace"), "namespace")


@R.add("a7_audit_sources", f"WITH {sql_quality('documents', 'source', 'text')} SELECT source, {_Q_OUT} FROM q4")
def _(spark, base):
    return rounded(A.quality(table(spark, base, "documents", "source", "text"), "source"), "source")


@R.add("d22_purge_quality", f"WITH {sql_quality('mcp_documents', 'namespace', 'text')} SELECT d.row_no FROM mcp_documents d WHERE NOT EXISTS (SELECT 1 FROM q4 WHERE q4.namespace = d.namespace AND overall < 0.82)")
def _(spark, base):
    return A.without_poor(docs(spark, base, "row_no", "namespace", "text"), "namespace", "text", 0.82).select("row_no")


# ---- overviews -------------------------------------------------------------------
@R.add("a1_list_namespaces", "SELECT namespace, count(*) AS n FROM mcp_documents GROUP BY 1 ORDER BY 1")
def _(spark, base):
    return docs(spark, base, "namespace").groupBy("namespace").agg(F.count("*").alias("n")).orderBy("namespace")


@R.add("a2_discovery", f"SELECT namespace, count(*) AS n, max({text_value('indexed_at')}) AS last_activity FROM mcp_documents GROUP BY 1 ORDER BY n DESC, namespace")
def _(spark, base):
    d = docs(spark, base, "namespace", "metadata").groupBy("namespace").agg(F.count("*").alias("n"), F.max(M.text_value(M.parsed(), "indexed_at")).alias("last_activity"))
    return d.orderBy(F.desc("n"), "namespace")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE coalesce(layer, 0) = {k}) AS {n}" for k, (n, _) in X.LAYERS.items())


@R.add("a3_overview", f"SELECT namespace, count(*) AS total, {_COUNTS}, bool_or(t IS NOT NULL) AS has_times, min(t) AS first_time, max(t) AS last_time FROM (SELECT namespace, layer, {first_present()} AS t FROM mcp_documents) GROUP BY 1")
def _(spark, base):
    return A.overview(docs(spark, base, "namespace", "layer", "metadata"))


_KEYWORDS = """SELECT {g}, unnest(from_json(keywords, '["VARCHAR"]')) AS keyword FROM {t} WHERE json_valid(keywords)"""


@R.add("a3_top_keywords", f"SELECT namespace, keyword, n, row_number() OVER (PARTITION BY namespace ORDER BY n DESC, keyword) AS rank FROM (SELECT namespace, keyword, count(*) AS n FROM ({_KEYWORDS.format(g='namespace', t='mcp_documents')}) GROUP BY 1, 2) QUALIFY rank <= 10")
def _(spark, base):
    return A.top_keywords(docs(spark, base, "namespace", "keywords"), "namespace").withColumn("rank", F.col("rank").cast("long"))


@R.add("a4_namespace_summary", f"SELECT namespace, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM (SELECT namespace, keyword FROM (SELECT DISTINCT namespace, keyword FROM ({_KEYWORDS.format(g='namespace', t='mcp_documents')})) QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY keyword) <= 20) GROUP BY 1")
def _(spark, base):
    k = docs(spark, base, "namespace", "keywords").select("namespace", F.explode(M.string_array("keywords")).alias("keyword")).distinct()
    first = k.withColumn("n", F.row_number().over(Window.partitionBy("namespace").orderBy("keyword"))).where("n <= 20")
    return first.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords"))


@R.add("a11_layer_keywords", f"SELECT layer, keyword, n, row_number() OVER (PARTITION BY layer ORDER BY n DESC, keyword) AS rank FROM (SELECT layer, keyword, count(*) AS n FROM ({_KEYWORDS.format(g='layer', t='onion_slices')}) GROUP BY 1, 2) QUALIFY rank <= 10")
def _(spark, base):
    return A.top_keywords(table(spark, base, "onion_slices", "layer", "keywords"), "layer").withColumn("rank", F.col("rank").cast("long"))


@R.add("a18_health", "SELECT count(*) AS row_count, round(count(*) * 4 / 1024.0, 6) AS size_mb, count(DISTINCT namespace) AS namespaces, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) > 100000 THEN 'optimize' ELSE 'healthy' END AS advice FROM mcp_documents")
def _(spark, base):
    n = F.count("*")
    return docs(spark, base, "namespace").agg(n.alias("row_count"), F.round(n * 4 / 1024.0, 6).alias("size_mb"), F.countDistinct("namespace").alias("namespaces"), F.when(n == 0, "empty").when(n > 100000, "optimize").otherwise("healthy").alias("advice"))


# ---- duplicates -------------------------------------------------------------------
def sql_report(by: str) -> str:
    return f"""SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE content_hash IS NULL), 0)::BIGINT AS without_hash, count(*) FILTER (WHERE content_hash IS NOT NULL) AS unique_hashes,
 count(*) FILTER (WHERE content_hash IS NOT NULL AND n > 1) AS duplicate_groups, coalesce(sum(n - 1) FILTER (WHERE content_hash IS NOT NULL), 0)::BIGINT AS removable FROM (SELECT content_hash, count(*) AS n FROM mcp_documents GROUP BY {by}content_hash)"""


@R.add("a5_dedup_report", sql_report("namespace, "))
def _(spark, base):
    return A.duplicate_report(docs(spark, base, "namespace", "content_hash"), ["namespace"])


@R.add("a5_dedup_cross_namespace", sql_report(""))
def _(spark, base):
    return A.duplicate_report(docs(spark, base, "content_hash"), [])


for _name, _order in (("oldest", "id, row_no"), ("newest", "id DESC, row_no"), ("scan_order", "row_no")):

    @R.add(f"a5_dedup_{_name}", f"SELECT row_no, row_number() OVER (PARTITION BY namespace, content_hash ORDER BY {_order}) = 1 AS kept FROM mcp_documents WHERE content_hash IS NOT NULL")
    def _(spark, base, name=_name):
        order = {"oldest": [F.asc("id"), F.asc("row_no")], "newest": [F.desc("id"), F.asc("row_no")], "scan_order": [F.asc("row_no")]}[name]
        return A.duplicates(docs(spark, base, "row_no", "id", "namespace", "content_hash"), ["namespace"], order).select("row_no", "kept")


_OWNER = f"coalesce(nullif({strip('(' + text_value('original_id') + ')')}, ''), nullif({strip('(' + text_value('doc_id') + ')')}, ''), id)"


@R.add("a6_collapse_families", f"""SELECT namespace, family, rec_no, id, text, members FROM (SELECT namespace, {_OWNER} AS family, rec_no, id, text, count(*) OVER (PARTITION BY namespace, {_OWNER}) AS members FROM import_records WHERE text IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY namespace, {_OWNER} ORDER BY strlen(text) DESC, rec_no) = 1)""")
def _(spark, base):
    return A.collapsed(table(spark, base, "import_records", "rec_no", "namespace", "id", "text", "metadata"))


@R.add("d20_reprocess", f"""SELECT namespace, family AS id, sha256({collapse('text')}) AS source_hash, members FROM (SELECT namespace, {_OWNER} AS family, rec_no, text, count(*) OVER (PARTITION BY namespace, {_OWNER}) AS members FROM import_records WHERE text IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY namespace, {_OWNER} ORDER BY strlen(text) DESC, rec_no) = 1) WHERE strlen(text) >= 50""")
def _(spark, base):
    c = A.collapsed(table(spark, base, "import_records", "rec_no", "namespace", "id", "text", "metadata"))
    return c.where(F.octet_length("text") >= 50).select("namespace", F.col("family").alias("id"), F.sha2(X.collapse("text"), 256).alias("source_hash"), "members")


@R.add("d21_reindex", "SELECT row_no, id, 'kb:venzeleth-reindexed' AS namespace, sha256(text) AS content_hash FROM mcp_documents WHERE namespace = 'kb:venzeleth' AND text IS NOT NULL")
def _(spark, base):
    d = docs(spark, base, "row_no", "id", "namespace", "text").where((F.col("namespace") == "kb:venzeleth") & F.col("text").isNotNull())
    return d.select("row_no", "id", F.concat("namespace", F.lit("-reindexed")).alias("namespace"), X.content_hash("text").alias("content_hash"))


# ---- time ---------------------------------------------------------------------------
_TL = f"tl AS (SELECT string_split(string_split(coalesce({text_value('indexed_at')}, 'unknown'), 'T')[1], ' ')[1] AS day, namespace, string_split(coalesce({text_value('path')}, 'unknown'), '/')[-1] AS source, count(*) AS n FROM mcp_documents GROUP BY 1, 2, 3)"
_DAYS = f"{_TL}, dd AS (SELECT DISTINCT TRY_CAST(day AS DATE) AS day FROM tl WHERE regexp_full_match(day, '\\d{{4}}-\\d\\d-\\d\\d') AND TRY_CAST(day AS DATE) IS NOT NULL)"


@R.add("a8_timeline", f"WITH {_TL} SELECT day, namespace, source, n FROM tl")
def _(spark, base):
    return A.timeline(docs(spark, base, "namespace", "metadata"))


@R.add("a9_coverage", f"WITH {_DAYS} SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days, (max(day) - min(day) + 1)::BIGINT AS span_days FROM dd")
def _(spark, base):
    return A.coverage(A.days(docs(spark, base, "namespace", "metadata")))


@R.add("w6_gaps", f"WITH {_DAYS} SELECT after_day, day AS next_day, (day - after_day - 1)::BIGINT AS missing FROM (SELECT day, lag(day) OVER (ORDER BY day) AS after_day FROM dd) WHERE day - after_day > 1")
def _(spark, base):
    return A.gaps(A.days(docs(spark, base, "namespace", "metadata")))


@R.add("a10_months", f"WITH {_TL} SELECT substr(day, 1, 7) AS month, sum(n)::BIGINT AS n, count(DISTINCT source) AS sources, min(source) AS first_source FROM tl GROUP BY 1")
def _(spark, base):
    t = A.timeline(docs(spark, base, "namespace", "metadata"))
    return t.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.sum("n").alias("n"), F.countDistinct("source").alias("sources"), F.min("source").alias("first_source"))


_OLD = f"SELECT row_no, namespace FROM (SELECT row_no, namespace, {first_present()} AS t FROM mcp_documents) WHERE {timestamp('t')} < TIMESTAMP '{CUTOFF}'"


@R.add("d23_old_rows", _OLD)
def _(spark, base):
    return A.old_rows(docs(spark, base, "row_no", "namespace", "metadata"), CUTOFF).select("row_no", "namespace")


@R.add("a12_garbage", f"""SELECT 'old' AS finding, namespace, count(*) AS n FROM ({_OLD}) GROUP BY 2 UNION ALL
SELECT 'orphan', namespace, count(*) FROM onion_slices WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM onion_slices WHERE id IS NOT NULL) GROUP BY 2""")
def _(spark, base):
    from ..operators.store import orphans

    old = A.old_rows(docs(spark, base, "row_no", "namespace", "metadata"), CUTOFF).groupBy("namespace").agg(F.count("*").alias("n"))
    lost = orphans(table(spark, base, "onion_slices", "namespace", "id", "parent_id")).groupBy("namespace").agg(F.count("*").alias("n"))
    return old.select(F.lit("old").alias("finding"), "namespace", "n").unionByName(lost.select(F.lit("orphan").alias("finding"), "namespace", "n"))


# ---- merging and recovery --------------------------------------------------------------
_THIRDS = "SELECT row_no, namespace, content_hash, (row_no % 3) AS source FROM mcp_documents"
_COPIED = f"SELECT *, content_hash IS NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY source, row_no) = 1 AS copied FROM ({_THIRDS})"


def _merged(spark, base):
    d = docs(spark, base, "row_no", "namespace", "content_hash")
    return A.merged([d.where(F.col("row_no") % 3 == i) for i in range(3)])


@R.add("u1_merge_stores", f"SELECT row_no, source::INT AS source, copied FROM ({_COPIED})")
def _(spark, base):
    return _merged(spark, base).select("row_no", "source", "copied")


@R.add("a13_merge_statistics", f"SELECT source::INT AS source, count(*) AS total, count(*) FILTER (WHERE copied) AS copied, count(*) FILTER (WHERE NOT copied) AS skipped, count(DISTINCT namespace) AS namespaces FROM ({_COPIED}) GROUP BY 1")
def _(spark, base):
    m = _merged(spark, base)
    return m.groupBy("source").agg(F.count("*").alias("total"), F.count_if("copied").alias("copied"), F.count_if(~F.col("copied")).alias("skipped"), F.countDistinct("namespace").alias("namespaces"))


@R.add("u3_migrate_namespace", "SELECT CASE WHEN namespace = 'kb:venzeleth' THEN 'kb:moved' ELSE namespace END AS namespace, count(*) AS n FROM mcp_documents GROUP BY 1")
def _(spark, base):
    return A.migrated(docs(spark, base, "row_no", "namespace"), "kb:venzeleth", "kb:moved", delete_source=True).groupBy("namespace").agg(F.count("*").alias("n"))


@R.add("u5_hash_difference", "SELECT DISTINCT content_hash FROM import_records WHERE content_hash IS NOT NULL EXCEPT SELECT content_hash FROM mcp_documents")
def _(spark, base):
    a = table(spark, base, "import_records", "content_hash").where("content_hash is not null").distinct()
    return a.join(docs(spark, base, "content_hash").distinct(), "content_hash", "left_anti")


@R.add("j8_recovery_states", """WITH l AS (SELECT batch_no AS batch_id, CASE WHEN batch_no % 5 = 0 THEN 'rolled_back' ELSE 'pending' END AS status, namespace, id FROM import_records),
v AS (SELECT DISTINCT namespace, id, 1 AS v FROM mcp_documents), k AS (SELECT DISTINCT namespace, id, 1 AS k FROM mcp_documents WHERE row_no % 2 = 0),
c AS (SELECT batch_id, status, count(*) AS documents, count(*) FILTER (WHERE v = 1) AS in_vectors, count(*) FILTER (WHERE v = 1 AND k = 1) AS in_keywords, count(*) FILTER (WHERE v = 1 AND k IS NULL) AS missing_keywords, count(*) FILTER (WHERE v IS NULL) AS missing_vectors FROM l LEFT JOIN v USING (namespace, id) LEFT JOIN k USING (namespace, id) GROUP BY 1, 2)
SELECT *, CASE WHEN missing_keywords > 0 THEN 'divergent' WHEN status = 'rolled_back' THEN 'rolled_back' WHEN missing_vectors > 0 OR in_vectors = 0 THEN 'stale' ELSE 'clean' END AS state FROM c""")
def _(spark, base):
    ledger = table(spark, base, "import_records", F.col("batch_no").alias("batch_id"), F.when(F.col("batch_no") % 5 == 0, "rolled_back").otherwise("pending").alias("status"), "namespace", "id")
    d = docs(spark, base, "row_no", "namespace", "id")
    return A.recovery(ledger, d, d.where(F.col("row_no") % 2 == 0))


# ---- pipeline events ----------------------------------------------------------------------
@R.add("a19_pipeline_counters", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, base):
    return table(spark, base, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@R.add("a20_progress_ema", """WITH RECURSIVE e AS (SELECT date_trunc('day', ts) AS day, row_number() OVER (ORDER BY date_trunc('day', ts)) AS i, avg(value) AS v FROM events GROUP BY 1),
r AS (SELECT day, i, v AS ema FROM e WHERE i = 1 UNION ALL SELECT e.day, e.i, 0.3 * e.v + 0.7 * r.ema FROM r JOIN e ON e.i = r.i + 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(ema, 6) AS ema FROM r""")
def _(spark, base):
    e = table(spark, base, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    return A.smoothed(e, "day", "v").select("day", F.round("ema", 6).alias("ema"))


@R.add("a21_rolling_rate", """SELECT event_id, round(CASE WHEN s > 0 THEN (n - 1) / (s / 1e6) END, 6) AS rate FROM (SELECT event_id, count(*) OVER w AS n, epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w) AS s FROM events
 WINDOW w AS (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""")
def _(spark, base):
    e = table(spark, base, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return A.rolling_rate(e.withColumn("h", F.date_trunc("hour", "ts")), "h", "ts", "event_id").select("event_id", F.round("rate", 6).alias("rate"))


@R.add("a23_scan_estimate")
def _(spark, base):
    from ..sources.files import estimate, listing

    return estimate(listing(spark, base, "*.parquet", recursive=False))
