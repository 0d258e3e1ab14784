"""From documents to slices and chunks: layers, sentence chunks, windows, sections and enriched chunks.

Algorithms that walk through a text run on Arrow batches (mapInArrow), one row
in, several out, without a shuffle; the rest are column expressions.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pytext as P
from ..functions import text as X
from .parallel import busy

SLICE = [("id", "string"), ("layer", "int"), ("content", "string"), ("parent_id", "string"), ("children_ids", "array<string>"), ("keywords", "array<string>")]


def _rows_from(df: DataFrame, make, fields: list[tuple[str, str]], keep: list[str], needs: list[str]) -> DataFrame:
    """One output row per dict that `make` yields for the `needs` of a row, beside the `keep` columns."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in fields)
    schema = T.StructType([*(df.schema[k] for k in keep), *T._parse_datatype_string(ddl).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(schema.fields[len(keep) :]))

    def run(batches):
        for batch in batches:
            at, made = [], []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in needs), strict=True)):
                for row in make(*values):
                    at.append(i)
                    made.append(row)
            index = pa.array(at, pa.int64())
            new = [pa.array([r[f.name] for r in made], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keep), *new], schema.names)

    return busy(df.select(*dict.fromkeys([*keep, *needs]))).mapInArrow(run, schema)


def _meta(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def sliced(df: DataFrame, keep: list[str], text: str = "text", metadata: str = "metadata", fast: bool = False) -> DataFrame:
    """The layers of every text, by the mode its metadata asks for; null texts give none."""
    return _rows_from(df, lambda t, m: P.slices(t, _meta(m), fast) if t is not None else (), SLICE, keep, [text, metadata])


def sentence_chunks(df: DataFrame, keep: list[str], text: str = "text", target: int = 512, overlap: int = 128) -> DataFrame:
    """(keep, chunk_index, total_chunks, chunk)."""

    def make(t):
        parts = P.sentence_chunks(t, target, overlap) if t else []
        return [{"chunk_index": i, "total_chunks": len(parts), "chunk": c} for i, c in enumerate(parts)]

    return _rows_from(df, make, [("chunk_index", "int"), ("total_chunks", "int"), ("chunk", "string")], keep, [text])


def window_chunks(df: DataFrame, keep: list[str], text: str = "text", size: int = 512, overlap: int = 128) -> DataFrame:
    """(keep, chunk_index, chunk): fixed windows, an expression without Python."""
    return df.select(*keep, F.posexplode(X.fixed_windows(text, size, overlap)).alias("chunk_index", "chunk"))


def sections(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, section_index, heading, body) between Markdown headings."""

    def make(t):
        return [{"section_index": i, "heading": h, "body": b} for i, (h, b) in enumerate(P.sections(t))] if t else []

    return _rows_from(df, make, [("section_index", "int"), ("heading", "string"), ("body", "string")], keep, [text])


def enriched(df: DataFrame, keep: list[str], text: str = "text", path: str = "path", target: int = 512, overlap: int = 128) -> DataFrame:
    """Sentence chunks of every section, numbered through the document, with source, section and type in front."""

    def make(t):
        if not t:
            return []
        parts = [(h, c) for h, b in P.sections(t) for c in P.sentence_chunks(b, target, overlap)]
        return [{"chunk_index": i, "section": h, "original": c} for i, (h, c) in enumerate(parts)]

    rows = _rows_from(df, make, [("chunk_index", "int"), ("section", "string"), ("original", "string")], [*keep, path] if path not in keep else keep, [text])
    prefix = X.context_prefix(X.file_name(path), "section", X.doc_type(path))
    return rows.withColumn("chunk", F.when(prefix == "", F.col("original")).otherwise(F.concat(prefix, F.lit("\n\n"), F.col("original"))))


def keywords(df: DataFrame, keep: list[str], text: str = "text", most: int = 10) -> DataFrame:
    """(keep, rank, keyword): the most frequent keywords of each text."""
    return _rows_from(df, lambda t: [{"rank": i, "keyword": k} for i, k in enumerate(P.keywords(t or "", most), 1)], [("rank", "int"), ("keyword", "string")], keep, [text])


def key_contents(df: DataFrame, keep: list[str], text: str = "text", most: int = 600) -> DataFrame:
    return _rows_from(df, lambda t: [{"content": P.key_content(t, most)}] if t is not None else [], [("content", "string")], keep, [text])


def split_sentences(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return _rows_from(df, lambda t: [{"sentence_index": i, "sentence": s} for i, s in enumerate(P.sentences(t or ""))], [("sentence_index", "int"), ("sentence", "string")], keep, [text])


def embed_batches(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, sentence_index, batch): the request of each sentence of a text, by number and characters."""

    def make(t):
        return [{"sentence_index": i, "batch": b} for i, b in enumerate(P.embed_batches([len(s) for s in P.sentences(t or "")]))]

    return _rows_from(df, make, [("sentence_index", "int"), ("batch", "int")], keep, [text])


def json_documents(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, element, kind, content): texts of a JSON value; elements of an array over 50 bytes each, else the whole; what isn't JSON is one text."""

    def make(t):
        if t is None:
            return []
        try:
            value = json.loads(t)
        except (ValueError, RecursionError):
            return [{"element": 0, "kind": "text", "content": t}]
        if isinstance(value, list):
            rows = [{"element": i, "kind": P.json_kind(v), "content": P.json_text(v)} for i, v in enumerate(value)]
            return [r for r in rows if P.size(r["content"]) > 50] or [{"element": 0, "kind": "array", "content": t}]
        return [{"element": 0, "kind": P.json_kind(value), "content": P.json_text(value)}]

    return _rows_from(df, make, [("element", "int"), ("kind", "string"), ("content", "string")], keep, [text])


def facets(df: DataFrame, keep: list[str], text: str = "content", metadata: str | None = None) -> DataFrame:
    """(keep, block, label, summary, decision, next_action, entities) of every block of a conversation text."""

    def make(t, m=None):
        for i, b in enumerate(P.blocks(t or "", _meta(m))):
            found = dict(reversed(b["facets"]))
            yield {"block": i, "label": b["label"], "summary": b["summary"], "decision": found.get("Decision"), "next_action": found.get("Next"), "entities": found.get("Entities")}

    return _rows_from(df, make, [("block", "int"), *((c, "string") for c in ("label", "summary", "decision", "next_action", "entities"))], keep, [text, *([metadata] if metadata else [])])


def conversation_entries(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, entry, session, role, time, body) of conversation exports in JSON; other texts give none."""

    def make(t):
        try:
            return P.conversation_entries(json.loads(t)) if t else []
        except (ValueError, RecursionError):
            return []

    return _rows_from(df, make, [("entry", "long"), *((c, "string") for c in ("session", "role", "time", "body"))], keep, [text])
