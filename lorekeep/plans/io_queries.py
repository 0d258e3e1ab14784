"""Sources, sinks, embedding hooks and streams as queries (S9-S18, K11, R27, R28, X1, X2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import embed as E
from ..operators import search as Q
from ..operators.durable import shared_folder
from ..operators.stored import DualStore
from ..sources import files, table
from ..streaming import activity, ingest
from ..streaming.pipeline import index_stream
from .registry import Registry, pieces
from .search_queries import query_vector, sql_near
from .text_queries import WINDOWS

R = Registry()


def scratch(spark, name: str) -> str:
    """A new folder in the shared folder of this application."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("s14_export_round_trip", "SELECT id, sha256(text) AS text_hash, content_hash FROM import_records WHERE text IS NOT NULL")
def _(spark, base):
    """Records written as JSON lines and read again."""
    out = scratch(spark, "export")
    files.write_export(table(spark, base, "import_records", "id", "text", F.lit(None).cast("string").alias("metadata"), "content_hash"), out)
    return files.export_lines(spark, out)[0].select("id", F.sha2("text", 256).alias("text_hash"), "content_hash")


@R.add("s11_text_files", "SELECT item_id::VARCHAR AS item_id, sha256(text || chr(10)) AS text_hash FROM eval_items WHERE text IS NOT NULL")
def _(spark, base):
    """Held-out items written as one text file each and read whole (a line end is added to each file)."""
    out = scratch(spark, "texts")
    items = table(spark, base, "eval_items", "item_id", "text").where("text is not null")
    items.repartition(8, "item_id").write.partitionBy("item_id").text(out)
    return files.texts(spark, out).select(F.regexp_extract("path", r"item_id=(\d+)", 1).alias("item_id"), F.sha2("text", 256).alias("text_hash"))


@R.add("s17_ledger_scan", "SELECT batch_no::VARCHAR AS batch_id, count(*) AS documents FROM import_records GROUP BY 1")
def _(spark, base):
    out = scratch(spark, "ledger")
    r = table(spark, base, "import_records", F.col("batch_no").cast("string").alias("batch_id"), "namespace", "id").withColumn("part", F.pmod(F.xxhash64("namespace", "id"), F.lit(16)))
    one = r.groupBy("batch_id", "part").agg(F.collect_list(F.struct("namespace", "id")).alias("documents"))
    one.select("batch_id", F.lit("pending").alias("status"), F.lit("2026-01-01").alias("created_at"), "documents").write.json(out)
    read = spark.read.schema(files.LEDGER_SCHEMA).json(out).select("batch_id", F.explode("documents").alias("d"))
    return read.groupBy("batch_id").agg(F.count("*").alias("documents"))


@R.add("s18_store_copy", "SELECT namespace, count(*) AS n FROM mcp_documents WHERE namespace <> '' GROUP BY 1")
def _(spark, base):
    """A store written by namespace and counted from its partitions."""
    out = scratch(spark, "copy")
    table(spark, base, "mcp_documents", "row_no", "namespace").where("namespace <> ''").write.partitionBy("namespace").parquet(out)
    return spark.read.parquet(out).groupBy(F.col("namespace").cast("string").alias("namespace")).agg(F.count("*").alias("n"))


@R.add("s9_list_files")
def _(spark, base):
    return files.listing(spark, base, "*.parquet", recursive=True).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


_BYTE = "(instr('0123456789ABCDEF', substr(hex(w), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(w), 2 * i, 1)) - 1"
_FNV = f"list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: ({_BYTE})::UHUGEINT), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


@R.add("r28_embed_documents", f"""WITH w AS (SELECT doc_id, unnest({pieces('lower(text)')}) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT w, ({_FNV} % 64)::INT AS place FROM (SELECT DISTINCT w FROM w)), n AS (SELECT doc_id, place, count(*) AS n FROM w JOIN f USING (w) GROUP BY 1, 2)
SELECT doc_id, place, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM n""")
def _(spark, base):
    v = E.embedded(table(spark, base, "documents", "doc_id", "text"), ["doc_id"])
    return v.select("doc_id", F.posexplode("vector").alias("place", "x")).where("x != 0").select("doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("value"))


_ASKED = "the stale parser checkpoint"


@R.add("r27_rerank", f"""WITH q AS (SELECT list_distinct(string_split('{_ASKED}', ' ')) AS q), c AS {sql_near('mcp_documents', 50)}
SELECT row_no, round(len(list_intersect(q, list_distinct({pieces("lower(coalesce(text, ''))")}))) / len(q), 6) AS score FROM c JOIN mcp_documents USING (row_no), q""")
def _(spark, base):
    """The nearest rows by vector, scored again by the reranker."""
    d = table(spark, base, "mcp_documents", "row_no", "vector", "text")
    near = Q.vector_top(d.select("row_no", "vector"), query_vector(spark, base), 50)
    hits = F.broadcast(near.select("row_no")).join(d.select("row_no", "text"), "row_no")  # 50 rows
    return E.reranked(hits, _ASKED, ["row_no"]).select("row_no", F.round("score", 6).alias("score"))


@R.add("x1_stream_ingest", "SELECT min(block_no) AS block_no, sha256(content) AS content_hash FROM raw_blocks WHERE strlen(content) >= 50 GROUP BY 2")
def _(spark, base):
    """Conversation blocks taken in as a stream, twice: the second run finds nothing new."""
    src = table(spark, base, "raw_blocks", "block_no", "content")
    out, mark, feed = scratch(spark, "ingest"), scratch(spark, "mark"), scratch(spark, "feed")
    src.write.parquet(feed)
    for _ in range(2):
        ingest(spark, feed, src.schema, out, mark, text="content")
    return spark.read.parquet(out).select("block_no", "content_hash")


@R.add("x1_pipeline", f"""WITH one AS (SELECT min(doc_id::VARCHAR) AS path, text FROM documents WHERE length(text) > 0 GROUP BY text)
SELECT path || '_' || (i - 1) AS id, sha256(w[i]) AS content_hash, 64 AS size, 0::TINYINT AS layer FROM (SELECT path, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT path, {WINDOWS} AS w FROM one))""")
def _(spark, base):
    """Documents taken in as files, cut, embedded, stored and indexed by one stream, which is started twice."""
    feed, mark = scratch(spark, "feed"), scratch(spark, "mark")
    table(spark, base, "documents", F.col("doc_id").cast("string").alias("path"), "text").coalesce(4).write.parquet(feed)
    store = DualStore(spark, scratch(spark, "dual"))
    for _ in range(2):
        index_stream(spark, feed, store, "files", mark)
    return store.store.documents("files").select("id", "content_hash", F.size("vector").alias("size"), "layer")


@R.add("x4_activity_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, base):
    """Hourly counts of the events as a stream, complete at its end."""
    e = table(spark, base, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    feed, mark, out = scratch(spark, "feed"), scratch(spark, "mark"), scratch(spark, "out")
    e.write.parquet(feed)
    stream = spark.readStream.schema(e.schema).parquet(feed)
    counts = activity(stream, "ts", "event_type", late="3650 days")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
