"""Cutting long texts at natural boundaries, with overlap.

A text over the limit is cut by a hierarchy of separators: sections, then
paragraphs, then sentences and lines, then words, and characters at last.  Only
parts that are still too long are cut at the next level.  The parts are packed
greedily into pieces up to the limit.  Each piece but the first begins with the
end of the one before: from the first sentence that starts within the last
`overlap` characters if that leaves at least half of them, else from a word.  Leaving out the overlaps, the pieces make up the
text exactly.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = (
    re.compile(r"\n(?=#{1,6}[ \t]\S)|\n[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*\n|\f"),  # a heading or rule follows
    re.compile(r"\n[ \t]*(?:\r?\n[ \t]*)+"),  # blank lines
    re.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+\s+|[。！？]+[」』）]*\s*|\n"),  # sentences and lines
    re.compile(r"\s+"),  # words
)


def _splits_glyph(text: str, at: int) -> bool:
    c = text[at]
    return unicodedata.combining(c) != 0 or c in "‍️" or text[at - 1] == "‍" or (c == "\n" and text[at - 1] == "\r")


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of `text`, by positions counted from 0."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0)] if n else []
    room = limit - overlap  # longest part that fits a piece behind any overlap
    ends = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in LEVELS]

    parts: list[int] = []  # ends of the parts, in order
    todo = [(0, n, 0)]
    while todo:
        s, e, level = todo.pop()
        if e - s <= room:
            parts.append(e)
        elif level < len(LEVELS):
            b = ends[level]
            inner = b[np.searchsorted(b, s, "right") : np.searchsorted(b, e, "left")].tolist()
            bounds = [s, *inner, e]
            todo += [(x, y, level + 1) for x, y in zip(bounds[-2::-1], bounds[:0:-1], strict=True)]
        else:
            at = s
            while e - at > room:
                to = at + room
                while to > at + 1 and to > at + room - 32 and _splits_glyph(text, to):
                    to -= 1
                parts.append(to)
                at = to
            parts.append(e)

    out: list[tuple[int, int, int]] = []
    start = begin = end = 0
    for p in parts:
        if p - start > limit:
            out.append((start, end, begin - start))
            begin = end
            start = _overlap_start(text, ends, end, overlap, limit - (p - end))
        end = p
    out.append((start, end, begin - start))
    return out


def _overlap_start(text: str, ends: list[np.ndarray], end: int, overlap: int, most: int) -> int:
    low = max(0, end - min(overlap, most))
    for b, least in ((ends[2], (end - low) // 2), (ends[3], 1)):  # a sentence that leaves at least half of the overlap, or a word
        i = int(np.searchsorted(b, low, "left"))
        if i < len(b) and b[i] <= end - least:
            return int(b[i])
    while low < end and low and _splits_glyph(text, low):
        low += 1
    return low


def split_long(df: DataFrame, key: str, text: str, limit: int, overlap: int = 128) -> DataFrame:
    """(key, piece_no, pieces, start_at, overlap, piece) for every non-null, non-empty `text`.

    Texts within the limit come out whole, without leaving the JVM.  piece_no
    and start_at (the position of the piece's first character) count from 1.
    Repeated keys each give their pieces.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    base = df.select(key, F.col(text).alias("_t")).where(F.length("_t") > 0)
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "pieces", "start_at", "overlap")), T.StructField("piece", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, t in enumerate(batch.column("_t").to_pylist()):
                got = spans(t, limit, overlap)
                for no, (s, e, o) in enumerate(got, 1):
                    rows.append(i)
                    for c, v in zip(cols, (no, len(got), s + 1, o, t[s:e]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())], schema.names)

    long = base.where(F.length("_t") > limit).mapInArrow(run, schema)
    one = F.lit(1)
    short = base.where(F.length("_t") <= limit).select(key, one.alias("piece_no"), one.alias("pieces"), one.alias("start_at"), F.lit(0).alias("overlap"), F.col("_t").alias("piece"))
    return long.unionByName(short)


def _here(spark, base) -> DataFrame:
    docs = spark.read.parquet(f"{base}/mcp_documents.parquet").select(F.col("row_no").alias("rec_no"), "text")
    slices = spark.read.parquet(f"{base}/onion_slices.parquet").select(F.col("slice_no").alias("rec_no"), "content")
    return split_long(docs, "rec_no", "text", 2048).withColumn("src", F.lit("mcp_documents")).unionByName(split_long(slices, "rec_no", "content", 512).withColumn("src", F.lit("onion_slices")))


def p1_found(spark, base) -> DataFrame:
    return _here(spark, base).where((F.col("pieces") > 1) & (F.col("piece_no") == 1)).select("src", "rec_no")


def p1_pieces(spark, base) -> DataFrame:
    return _here(spark, base).select("src", "rec_no", "piece_no", "pieces", "start_at", "overlap", "piece")


def p1_sizes(spark, base) -> DataFrame:
    """Per source: items, characters with overlaps left out, and whether all pieces keep to the limit and the overlap and lie side by side."""
    p = _here(spark, base)
    limit = F.when(F.col("src") == "mcp_documents", 2048).otherwise(512)
    start, size = F.col("start_at"), F.length("piece")
    item = p.groupBy("src", "rec_no").agg(
        F.max(size - limit).alias("over"), F.max("overlap").alias("overlap"), F.sum(size - F.col("overlap")).alias("chars"), F.max(start + size - 1).alias("last"), F.min(start).alias("first"), F.max("pieces").alias("pieces"), F.count("*").alias("n")
    )
    fits = (F.col("first") == 1) & (F.col("last") == F.col("chars")) & (F.col("pieces") == F.col("n"))
    return item.groupBy("src").agg(F.count("*").alias("items"), F.sum("chars").alias("chars"), (F.max("over") <= 0).alias("within_limit"), (F.max("overlap") <= 128).alias("within_overlap"), F.every(fits).alias("in_order"))


P1_FOUND_SQL = """
SELECT 'mcp_documents' AS src, row_no AS rec_no FROM mcp_documents WHERE length(text) > 2048
UNION ALL SELECT 'onion_slices', slice_no FROM onion_slices WHERE length(content) > 512
"""
