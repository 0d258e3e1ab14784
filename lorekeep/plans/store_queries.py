"""Scans, filters, joins and mutations of the store (S, F, J, K)."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from ..operators import store as S
from ..operators.durable import shared_folder
from ..operators.stored import DualStore, Store
from ..sources import table
from .registry import Registry, text_value, usable

R = Registry()
NS, OTHER = "agent:shared-memory", "kb:venzeleth"


def docs(spark, base, *cols):
    return table(spark, base, "mcp_documents", *cols)


@R.add("s2_browse_page", f"SELECT row_no, id, namespace, text FROM mcp_documents WHERE namespace = '{NS}' ORDER BY row_no LIMIT 25 OFFSET 10")
def _(spark, base):
    return S.page(docs(spark, base, "row_no", "id", "namespace", "text"), 10, 25, NS)


@R.add("s3_bounded_scan", "SELECT row_no, id, namespace FROM mcp_documents ORDER BY row_no LIMIT 100")
def _(spark, base):
    return S.page(docs(spark, base, "row_no", "id", "namespace"), 0, 100)


@R.add("s4_namespace_scan", f"SELECT row_no, id, layer, text FROM mcp_documents WHERE namespace = '{NS}'")
def _(spark, base):
    return S.in_namespace(docs(spark, base), NS).select("row_no", "id", "layer", "text")


@R.add("s5_point_lookup", f"""SELECT row_no, id, namespace, text FROM mcp_documents WHERE namespace = '{NS}' AND id = (SELECT min(id) FROM mcp_documents WHERE namespace = '{NS}' AND id <> '') ORDER BY row_no LIMIT 1""")
def _(spark, base):
    d = docs(spark, base, "row_no", "id", "namespace", "text")
    id_ = d.where((F.col("namespace") == NS) & (F.col("id") != "")).agg(F.min("id")).first()[0]
    return S.lookup(d, NS, id_ or "")


@R.add("s6_predicate_scan", f"SELECT row_no, id, layer FROM mcp_documents WHERE namespace = '{NS}' AND layer = 4 AND parent_id IS NULL AND length(text) > 400")
def _(spark, base):
    return S.in_namespace(docs(spark, base), NS, "layer = 4 AND parent_id IS NULL AND length(text) > 400").select("row_no", "id", "layer")


@R.add("s7_namespace_exists", f"""SELECT n.namespace, count(d.row_no) AS n, count(d.row_no) > 0 AS is_there FROM (VALUES ('{NS}'), ('{OTHER}'), ('no such namespace')) n(namespace) LEFT JOIN mcp_documents d ON d.namespace = n.namespace GROUP BY 1""")
def _(spark, base):
    asked = spark.createDataFrame([(NS,), (OTHER,), ("no such namespace",)], "namespace string")
    n = docs(spark, base, "namespace").where(F.col("namespace").isin(NS, OTHER, "no such namespace")).groupBy("namespace").agg(F.count("*").alias("n"))
    return asked.join(n, "namespace", "left").select("namespace", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("is_there"))


@R.add("s8_table_stats", "SELECT 'mcp_documents' AS name, count(*) AS row_count, count(DISTINCT namespace) AS namespaces, count(*) FILTER (WHERE text IS NULL) AS without_text FROM mcp_documents")
def _(spark, base):
    return docs(spark, base, "namespace", "text").agg(F.lit("mcp_documents").alias("name"), F.count("*").alias("row_count"), F.countDistinct("namespace").alias("namespaces"), F.count_if(F.col("text").isNull()).alias("without_text"))


@R.add("f2_layer_outer", "SELECT row_no, namespace, layer FROM mcp_documents WHERE layer IN (0, 1)")
def _(spark, base):
    return docs(spark, base, "row_no", "namespace", "layer").where(S.layer_predicate(1))


@R.add("f3_layer_selection", """SELECT c.choice, count(d.row_no) AS n FROM (VALUES ('default'), ('deep'), ('middle'), ('inner'), ('core')) c(choice)
LEFT JOIN mcp_documents d ON (c.choice = 'default' AND d.layer IN (0, 1)) OR c.choice = 'deep' OR (c.choice = 'middle' AND d.layer = 2) OR (c.choice = 'inner' AND d.layer = 3) OR (c.choice = 'core' AND d.layer = 4) GROUP BY 1""")
def _(spark, base):
    d = docs(spark, base, "layer")
    choices = {"default": 1, "deep": None, "middle": 2, "inner": 3, "core": 4}
    sums = d.agg(*[F.coalesce(F.sum(F.coalesce(S.layer_predicate(code), F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, code in choices.items()])
    return sums.unpivot([], list(choices), "choice", "n")


_PROJECT = " OR ".join(f"coalesce(lower({text_value(k)}) = 'lonyarond', false)" for k in ("project", "project_id", "source_project"))


@R.add("f4_project_filter", f"SELECT row_no, namespace FROM mcp_documents WHERE {_PROJECT}")
def _(spark, base):
    return docs(spark, base, "row_no", "namespace", "metadata").where(M.in_project(M.parsed(), " Lonyarond ")).select("row_no", "namespace")


_DATE = text_value("date")


@R.add("f5_meta_filter", f"""SELECT row_no, namespace FROM mcp_documents WHERE coalesce({text_value('type')} = 'note', false) AND coalesce({text_value('format')} = 'markdown', false)
 AND coalesce({_DATE} >= '2025-03', true) AND coalesce({_DATE} <= '2026-09', true)""")
def _(spark, base):
    return docs(spark, base, "row_no", "namespace", "metadata").where(M.meta_filter(M.parsed(), {"type": "note", "format": "markdown"}, "2025-03", "2026-09")).select("row_no", "namespace")


@R.add("f6_min_lengths", """SELECT count(*) FILTER (WHERE strlen(text) >= 50) AS documents, count(*) FILTER (WHERE strlen(text) > 50) AS elements, count(*) FILTER (WHERE strlen(text) >= 20) AS messages, count(*) AS total FROM mcp_documents""")
def _(spark, base):
    n = F.octet_length("text")
    return docs(spark, base, "text").agg(F.count_if(n >= 50).alias("documents"), F.count_if(n > 50).alias("elements"), F.count_if(n >= 20).alias("messages"), F.count("*").alias("total"))


@R.add("f7_glob_filter", "SELECT doc_id, path FROM documents WHERE regexp_matches(path, '(^|/)[^/]*-1[^/]*\\.md$')")
def _(spark, base):
    from ..sources.files import glob_column

    return table(spark, base, "documents", "doc_id", "path").where(glob_column("path", "*-1*.md"))


@R.add("f8_resume_filter", """SELECT d.doc_id, d.path FROM documents d WHERE d.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents c WHERE c.path = d.path AND c.ingested_at < TIMESTAMP '2025-09-01')""")
def _(spark, base):
    d = table(spark, base, "documents", "doc_id", "path", "ingested_at").where("path is not null")
    done = d.where(F.col("ingested_at") < F.lit("2025-09-01").cast("timestamp_ntz")).select("path").distinct()
    return d.join(done, "path", "left_anti").select("doc_id", "path")


@R.add("f9_stored_hash_probe", """SELECT rec_no, EXISTS (SELECT 1 FROM mcp_documents d WHERE d.namespace = r.namespace AND d.content_hash = sha256(r.text)) AS stored FROM import_records r""")
def _(spark, base):
    known = docs(spark, base, "namespace", "content_hash").where("content_hash is not null").distinct().withColumn("stored", F.lit(True))
    r = table(spark, base, "import_records", "rec_no", "namespace", "text").withColumn("content_hash", X.content_hash("text"))
    return r.join(known, ["namespace", "content_hash"], "left").select("rec_no", F.coalesce("stored", F.lit(False)).alias("stored"))


@R.add("f10_new_hashes", """SELECT DISTINCT r.namespace, r.content_hash FROM import_records r WHERE r.content_hash IS NOT NULL AND r.namespace IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM mcp_documents d WHERE d.namespace = r.namespace AND d.content_hash = r.content_hash)""")
def _(spark, base):
    return S.new_hashes(table(spark, base, "import_records", "namespace", "content_hash").where("namespace is not null"), docs(spark, base, "namespace", "content_hash"))


@R.add("f11_access", """SELECT namespace, count(*) AS n FROM mcp_documents WHERE namespace NOT IN ('kb:venzeleth', 'team:selmelard') OR namespace = 'team:selmelard' GROUP BY 1""")
def _(spark, base):
    tokens, given = {"kb:venzeleth": "k1", "team:selmelard": "k2"}, {"team:selmelard": "k2", "kb:venzeleth": "wrong"}
    locked = [n for n in tokens if not S.allowed(n, given.get(n), tokens)]
    return docs(spark, base, "namespace").where(~F.col("namespace").isin(*locked)).groupBy("namespace").agg(F.count("*").alias("n"))


@R.add("f12_result_preview", f"""SELECT row_no, id, substr(text, 1, 200) AS preview, length(text) > 200 AS is_cut, {text_value('path')} AS source FROM mcp_documents WHERE text IS NOT NULL""")
def _(spark, base):
    d = docs(spark, base, "row_no", "id", "text", "metadata").where("text is not null")
    return d.select("row_no", "id", F.substring("text", 1, 200).alias("preview"), (F.length("text") > 200).alias("is_cut"), M.text_value(M.parsed(), "path").alias("source"))


@R.add("f13_can_expand", """SELECT row_no, coalesce(CASE WHEN json_valid(children_ids) THEN json_array_length(children_ids) END, 0) > 0 AS can_expand, parent_id IS NOT NULL AS can_drill_up FROM mcp_documents""")
def _(spark, base):
    return docs(spark, base, "row_no", "children_ids", "parent_id").select("row_no", (F.size(M.string_array("children_ids")) > 0).alias("can_expand"), F.col("parent_id").isNotNull().alias("can_drill_up"))


@R.add("f14_since_filter", f"""SELECT row_no FROM (SELECT row_no, {text_value('indexed_at')} AS t FROM mcp_documents) WHERE coalesce(TRY_CAST(substr(t, 1, 10) AS DATE) >= DATE '2026-03-01', true)""")
def _(spark, base):
    day = F.expr("try_cast(substr(t, 1, 10) as date)")
    return docs(spark, base, "row_no", "metadata").select("row_no", M.text_value(M.parsed(), "indexed_at").alias("t")).where(F.coalesce(day >= F.lit("2026-03-01").cast("date"), F.lit(True))).select("row_no")


# ---- joins -----------------------------------------------------------------
_KIDS = """SELECT namespace, id AS parent_id, generate_subscripts(kids, 1) - 1 AS pos, unnest(kids) AS child_id FROM (SELECT namespace, id, from_json(children_ids, '["VARCHAR"]') AS kids FROM {t} WHERE json_valid(children_ids))"""


@R.add("j1_expand_children", f"""WITH k AS ({_KIDS.format(t='mcp_documents')}), r AS (SELECT namespace, id, min(row_no) AS child_row FROM mcp_documents GROUP BY ALL)
SELECT k.namespace, k.parent_id, k.pos::BIGINT AS pos, k.child_id, r.child_row FROM k JOIN r ON r.namespace = k.namespace AND r.id = k.child_id""")
def _(spark, base):
    return S.children(docs(spark, base, "row_no", "namespace", "id", "children_ids"))


@R.add("j2_drill_up", """WITH r AS (SELECT namespace, id, min(row_no) AS parent_row FROM mcp_documents GROUP BY ALL)
SELECT d.row_no, d.namespace, d.id, d.parent_id, r.parent_row FROM mcp_documents d JOIN r ON r.namespace = d.namespace AND r.id = d.parent_id""")
def _(spark, base):
    return S.parents(docs(spark, base, "row_no", "namespace", "id", "parent_id"))


@R.add("j1_slice_children", f"""WITH k AS ({_KIDS.format(t='onion_slices')}), r AS (SELECT namespace, id, min(slice_no) AS child_row FROM onion_slices GROUP BY ALL)
SELECT k.namespace, k.parent_id, k.pos::BIGINT AS pos, k.child_id, r.child_row FROM k JOIN r ON r.namespace = k.namespace AND r.id = k.child_id""")
def _(spark, base):
    return S.children(table(spark, base, "onion_slices", F.col("slice_no").alias("row_no"), "namespace", "id", "children_ids"))


@R.add("j6_orphans", """SELECT row_no, namespace, id, parent_id FROM mcp_documents WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM mcp_documents WHERE id IS NOT NULL)""")
def _(spark, base):
    return S.orphans(docs(spark, base, "row_no", "namespace", "id", "parent_id")).select("row_no", "namespace", "id", "parent_id")


@R.add("j6_slice_orphans", """SELECT slice_no, namespace, id, parent_id FROM onion_slices WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM onion_slices WHERE id IS NOT NULL)""")
def _(spark, base):
    return S.orphans(table(spark, base, "onion_slices", "slice_no", "namespace", "id", "parent_id")).select("slice_no", "namespace", "id", "parent_id")


@R.add("j9_rebuild_probe", """SELECT r.rec_no, count(d.row_no) AS stored_rows FROM import_records r LEFT JOIN mcp_documents d ON d.namespace = r.namespace AND d.id = r.id GROUP BY 1""")
def _(spark, base):
    n = docs(spark, base, "namespace", "id").groupBy("namespace", "id").agg(F.count("*").alias("n"))
    return table(spark, base, "import_records", "rec_no", "namespace", "id").join(n, ["namespace", "id"], "left").select("rec_no", F.coalesce("n", F.lit(0)).alias("stored_rows"))


# ---- sinks and mutations ----------------------------------------------------
@R.add("k1_validation", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(id, '') = '' THEN 'empty id' WHEN coalesce(namespace, '') = '' THEN 'empty namespace'
 WHEN vector IS NULL OR len(vector) = 0 THEN 'empty vector' WHEN len(vector) <> 64 THEN 'wrong dimension' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'value not finite' ELSE 'ok' END AS reason FROM mcp_documents) GROUP BY 1""")
def _(spark, base):
    return docs(spark, base, "id", "namespace", "vector").groupBy(F.coalesce(S.invalid_reason(64), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@R.add("k2_batch_new", """WITH one AS (SELECT * FROM import_records QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY rec_no) = 1),
h AS (SELECT * FROM one WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace, content_hash ORDER BY rec_no) = 1)
SELECT rec_no FROM h WHERE NOT EXISTS (SELECT 1 FROM mcp_documents d WHERE d.namespace = h.namespace AND d.content_hash = h.content_hash) UNION ALL SELECT rec_no FROM one WHERE content_hash IS NULL""")
def _(spark, base):
    return S.batch_new(table(spark, base, "import_records", "rec_no", "namespace", "id", "content_hash"), docs(spark, base, "namespace", "content_hash"), "rec_no").select("rec_no")


@R.add("k3_delete_key", f"""SELECT count(*) AS left_rows FROM mcp_documents WHERE NOT coalesce(namespace = '{NS}' AND id = (SELECT min(id) FROM mcp_documents WHERE namespace = '{NS}' AND id <> ''), false)""")
def _(spark, base):
    d = docs(spark, base, "namespace", "id")
    id_ = d.where((F.col("namespace") == NS) & (F.col("id") != "")).agg(F.min("id")).first()[0]
    return S.without_key(d, NS, id_).agg(F.count("*").alias("left_rows"))


@R.add("k4_delete_namespace", f"SELECT namespace, count(*) AS n FROM mcp_documents WHERE namespace IS DISTINCT FROM '{NS}' GROUP BY 1")
def _(spark, base):
    return S.without_namespace(docs(spark, base, "namespace"), NS).groupBy("namespace").agg(F.count("*").alias("n"))


@R.add("k5_delete_matching", f"SELECT row_no FROM mcp_documents WHERE NOT (namespace IS NOT DISTINCT FROM '{NS}' AND coalesce({text_value('type')} = 'note', false))")
def _(spark, base):
    return S.without_matching(docs(spark, base, "row_no", "namespace", "metadata"), NS, equals={"type": "note"}).select("row_no")


@R.add("k7_store_batch", f"""SELECT rec_no AS row_no, id, namespace, text, sha256(text) AS content_hash, 0::TINYINT AS layer FROM import_records WHERE batch_no = 1 AND namespace <> '' AND id <> ''""")
def _(spark, base):
    r = table(spark, base, "import_records").where((F.col("batch_no") == 1) & (F.col("namespace") != "") & (F.col("id") != ""))
    return r.select(F.col("rec_no").alias("row_no"), "id", "namespace", "text", X.content_hash("text").alias("content_hash"), F.lit(0).cast("tinyint").alias("layer"))


@R.add("k8_upsert_flat", f"""WITH n AS (SELECT namespace, id, max(rec_no) AS rec_no FROM import_records WHERE namespace <> '' AND id <> '' GROUP BY 1, 2)
SELECT 'stored' AS origin, row_no FROM mcp_documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.namespace = d.namespace AND (n.id = d.id OR n.id = coalesce({text_value('original_id', 'd.metadata')}, d.id))) UNION ALL SELECT 'new', rec_no FROM n""")
def _(spark, base):
    new = table(spark, base, "import_records").where((F.col("namespace") != "") & (F.col("id") != "")).groupBy("namespace", "id").agg(F.max("rec_no").alias("row_no"))
    new = new.withColumn("metadata", F.lit(None).cast("string")).withColumn("origin", F.lit("new"))
    stored = docs(spark, base, "row_no", "namespace", "id", "metadata").withColumn("origin", F.lit("stored"))
    return S.upserted(stored, new).select("origin", "row_no")


@R.add("k9_remove_family", f"""WITH x AS (SELECT min({text_value('original_id')}) AS o FROM mcp_documents WHERE namespace = '{NS}')
SELECT count(*) AS left_rows FROM mcp_documents WHERE NOT coalesce(namespace = '{NS}' AND (id = coalesce((SELECT o FROM x), 'none') OR coalesce({text_value('original_id')} = coalesce((SELECT o FROM x), 'none'), false)), false)""")
def _(spark, base):
    d = docs(spark, base, "namespace", "id", "metadata")
    id_ = d.where(F.col("namespace") == NS).agg(F.min(M.text_value(M.parsed(), "original_id"))).first()[0]
    return S.without_family(d, NS, id_ or "none").agg(F.count("*").alias("left_rows"))


@R.add("k11_export", f"SELECT id, namespace, text, content_hash, md5(concat_ws('|', id, namespace, text, content_hash)) AS line_hash FROM mcp_documents WHERE namespace = '{NS}'")
def _(spark, base):
    d = S.in_namespace(docs(spark, base), NS)
    return d.select("id", "namespace", "text", "content_hash", F.md5(F.concat_ws("|", "id", "namespace", "text", "content_hash")).alias("line_hash"))


@R.add("k12_import", """WITH h AS (SELECT rec_no, namespace, coalesce(content_hash, sha256(text)) AS content_hash FROM import_records),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY namespace, content_hash ORDER BY rec_no) = 1)
SELECT rec_no, content_hash FROM o WHERE NOT EXISTS (SELECT 1 FROM mcp_documents d WHERE d.namespace = o.namespace AND d.content_hash = o.content_hash)""")
def _(spark, base):
    return S.imported(table(spark, base, "import_records", "rec_no", "namespace", "content_hash", "text"), docs(spark, base, "namespace", "content_hash")).select("rec_no", "content_hash")


@R.add("k15_compaction", "SELECT namespace, count(*) AS n, 1 AS parts FROM mcp_documents GROUP BY 1")
def _(spark, base):
    """A store written in ten small batches, compacted: the rows of each namespace and the parts of its bucket."""
    d = docs(spark, base, *(f.name for f in S.DOCUMENT.fields))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=4)
    for batch in range(10):
        store.append(d.where(F.col("row_no") % 10 == batch), f"b{batch}")
    store.tidy(most_parts=8)
    parts = spark.createDataFrame(sorted(Counter(b for _, b in store.table.manifest.newest()["tables"]).items()), "b int, parts int")
    counts = store.documents().groupBy("namespace").agg(F.count("*").alias("n"))
    return counts.withColumn("b", store.table.bucket("namespace")).join(parts, "b").select("namespace", "n", "parts")


@R.add("k13_dual_write", """SELECT namespace, count(*) AS stored, count(text) AS indexed FROM mcp_documents GROUP BY 1""")
def _(spark, base):
    """Two batches to store and index; the second stops before the index, and recovery finishes it."""
    d = docs(spark, base, *(f.name for f in S.DOCUMENT.fields))
    both = DualStore(spark, f"{shared_folder(spark)}/dual-{uuid.uuid4().hex}")
    both.write(d.where(F.col("row_no") % 2 == 0), "b0")
    both.files.create(f"{both.pending}/b1.json", '{"batch_id": "b1", "status": "pending"}')
    both.store.append(d.where(F.col("row_no") % 2 == 1), "b1")
    both.recover()
    return _dual_counts(both)


@R.add("k14_dual_delete", f"""SELECT namespace, count(*) AS stored, count(text) AS indexed FROM mcp_documents WHERE NOT coalesce(namespace = '{NS}', false) GROUP BY 1""")
def _(spark, base):
    both = DualStore(spark, f"{shared_folder(spark)}/dual-{uuid.uuid4().hex}")
    both.write(docs(spark, base, *(f.name for f in S.DOCUMENT.fields)), "b0")
    both.delete(NS)
    return _dual_counts(both)


def _dual_counts(both: DualStore):
    stored = both.store.documents().groupBy("namespace").agg(F.count("*").alias("stored"))
    indexed = both.index._kept(both.index.rows.read()).groupBy("namespace").agg(F.count("*").alias("indexed"))
    return stored.join(indexed, stored["namespace"].eqNullSafe(indexed["namespace"]), "left").select(stored["namespace"], "stored", F.coalesce("indexed", F.lit(0)).alias("indexed"))


@R.add("r23_get", f"""SELECT row_no, id, layer FROM mcp_documents WHERE namespace = '{NS}' AND (id = (SELECT max(id) FROM mcp_documents WHERE namespace = '{NS}') OR coalesce({text_value('original_id')} = (SELECT max(id) FROM mcp_documents WHERE namespace = '{NS}'), false))
ORDER BY CASE WHEN id = (SELECT max(id) FROM mcp_documents WHERE namespace = '{NS}') THEN 0 ELSE 1 END, layer, row_no LIMIT 1""")
def _(spark, base):
    d = docs(spark, base, "row_no", "namespace", "id", "layer", "metadata")
    id_ = d.where(F.col("namespace") == NS).agg(F.max("id")).first()[0] or ""
    return S.best_of_family(d, NS, id_).select("row_no", "id", "layer")


@R.add("r24_family", f"""SELECT coalesce({text_value('original_id')}, id) AS family, namespace, count(*) AS members, min(layer)::TINYINT AS flattest FROM mcp_documents GROUP BY 1, 2""")
def _(spark, base):
    owner = F.coalesce(M.text_value(M.parsed(), "original_id"), F.col("id"))
    return docs(spark, base, "namespace", "id", "layer", "metadata").groupBy(owner.alias("family"), "namespace").agg(F.count("*").alias("members"), F.min("layer").alias("flattest"))


@R.add("w4_first_per_key", "SELECT namespace, id, min(row_no) AS row_no FROM mcp_documents WHERE namespace <> '' AND id <> '' GROUP BY 1, 2")
def _(spark, base):
    return S.first_written(docs(spark, base, "row_no", "namespace", "id")).select("namespace", "id", "row_no")


@R.add("a22_document_keys", "SELECT DISTINCT namespace, id FROM mcp_documents")
def _(spark, base):
    return docs(spark, base, "namespace", "id").distinct()


@R.add("t22_usable_vectors", f"SELECT namespace, count(*) FILTER (WHERE {usable()}) AS usable, count(*) AS total FROM mcp_documents GROUP BY 1")
def _(spark, base):
    return docs(spark, base, "namespace", "vector").groupBy("namespace").agg(F.count_if(S.usable()).alias("usable"), F.count("*").alias("total"))
