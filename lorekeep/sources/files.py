"""File sources: listings, texts, JSON lines and recovery ledgers, with guarded paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of files that are taken in from a folder.
INDEXABLE = ("md", "txt", "json", "jsonl", "rs", "py", "js", "ts", "tsx", "jsx", "toml", "yaml", "yml", "html", "css", "sql", "sh", "pdf")
EXPORT_SCHEMA = "id string, text string, metadata string, content_hash string, embeddings array<float>, _bad string"
LEDGER_SCHEMA = "batch_id string, status string, created_at string, documents array<struct<namespace:string,id:string>>, last_error string"


def checked_path(path: str, roots: tuple[str, ...] = ()) -> str:
    """`path`, unless it climbs, holds control characters or lies outside `roots`."""
    if not path or any(c in path for c in "\0\r\n") or re.search(r"(^|/)\.\.?(/|$)", path):
        raise ValueError(f"path not allowed: {path!r}")
    if roots and not any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots):
        raise ValueError(f"path outside the allowed folders: {path!r}")
    return path


def glob_column(path: str, pattern: str) -> Column:
    """The file name matches a glob."""
    body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(pattern))
    return F.element_at(F.split(F.col(path), "/"), -1).rlike(f"(?s)^{body}$")


def listing(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = True, max_depth: int = 0, indexable: bool = False) -> DataFrame:
    """(path, length, modified): files below a folder, to `max_depth` levels (0: all); contents are not read."""
    folder = checked_path(folder).rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        read = read.option("pathGlobFilter", glob)
    df = read.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    depth = F.size(F.split(F.substring_index(F.col("path"), folder, -1), "/")) - 1
    if not recursive:
        max_depth = 1
    if max_depth:
        df = df.where(depth <= max_depth)
    if indexable:
        name = F.element_at(F.split("path", "/"), -1)
        df = df.where(~name.startswith(".") & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*INDEXABLE))
    return df


def estimate(files: DataFrame, bytes_per_chunk: int = 500) -> DataFrame:
    """Files, bytes and the chunks they may give."""
    total = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(F.count("*").alias("files"), total.alias("bytes"), F.floor(total / bytes_per_chunk).cast("long").alias("chunks"))


def texts(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, text): whole files as UTF-8."""
    read = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(checked_path(folder)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of PDF files; needs the optional pypdf package on the executors."""

    def run(batches):
        import io

        import pyarrow as pa
        from pypdf import PdfReader  # not part of every installation

        for b in batches:
            out = ["\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(checked_path(folder)).select("path", "content").mapInArrow(run, "path string, text string")


def export_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines) of an export in JSON lines; blank lines are skipped, metadata stays JSON text."""
    raw = spark.read.text(checked_path(path)).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    meta = F.try_variant_get(v, "$.metadata", "variant")
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & text("text").isNotNull()
    records = raw.where(good).select(text("id").alias("id"), text("text").alias("text"), F.to_json(meta).alias("metadata"), text("content_hash").alias("content_hash"), F.from_json(F.get_json_object("value", "$.embeddings"), "array<float>").alias("embeddings"))
    return records, raw.where(~good).select(F.col("value").alias("line"))


def write_export(df: DataFrame, path: str, embeddings: bool = False) -> None:
    """One JSON object per line: id, text, metadata, content_hash and, if wanted, embeddings."""
    cols = [F.col("id"), F.col("text"), F.col("metadata"), F.col("content_hash"), *([F.col("vector").alias("embeddings")] if embeddings else [])]
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.text(path)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, status, created_at, namespace, id) of the recovery ledgers in a folder."""
    df = spark.read.schema(LEDGER_SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*.json").json(checked_path(folder))
    return df.select("batch_id", "status", "created_at", F.explode("documents").alias("d")).select("batch_id", "status", "created_at", "d.*").orderBy("created_at")


def copied_store(spark: SparkSession, source: str, target: str) -> None:
    """A foreign store's Parquet files, written anew by namespace."""
    spark.read.parquet(checked_path(source)).write.partitionBy("namespace").parquet(checked_path(target))
