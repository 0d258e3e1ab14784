"""One consistent form for texts that look the same.

The data and offset buffers of an Arrow column become one numpy array of code
points, a break behind every text; columns of plain ASCII pass as they are.  A
lookup table says for every code point how many it becomes, and at which offset of a
flat table they stand: none for characters without width, one for width
variants, blanks and look-alike letters, several for ligatures and for letters
with accents.  After that gather, marks are put in canonical order and composed
with their base letter by searching pair keys, mark rank by mark rank.  The
result is written as buffers again; no string is made for a row.

Line ends, tabs, case, accents, digits and spelling are kept.  Null stays null
and the empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import pairs_within
from ._spark import written

SLICE_BYTES = 1 << 20  # texts are taken together up to about so many bytes
BREAK = np.uint32(0x110000)  # no code point

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "г": "r", "Ь": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "ο": "o", "ν": "v", "ρ": "p", "σ": "o", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j",
    "Օ": "O", "Ս": "U", "օ": "o", "Տ": "S", "Լ": "L", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z", "Ꮃ": "W", "Ꮍ": "Y", "Ꭵ": "i", "Ꮷ": "d",
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
}
# Format characters that do show.
SHOWN_FORMAT = frozenset(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]))
# Compatibility forms that stand for the same glyphs, by the tag of their decomposition.
PLAIN_TAGS = frozenset(["<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"])
JOINED_LETTERS = frozenset(map(chr, [0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]))
TOP = 0x20000  # code points above have no entry but for the tags and selectors at 0xE0000
HANGUL = range(0xAC00, 0xD7A4)


def _plain(c: str, depth: int = 0) -> str:
    """What one character becomes, fully decomposed."""
    kind = unicodedata.category(c)
    if (kind == "Cf" and c not in SHOWN_FORMAT) or "︀" <= c <= "️" or c in "͏ᅟᅠ឴឵":
        return ""
    if kind == "Zs" and c != " ":
        return " "
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if ord(c) in HANGUL:
        return c
    tag, *codes = unicodedata.decomposition(c).split() or [""]
    joined = tag == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or c in JOINED_LETTERS)
    if not tag or (tag[0] == "<" and tag not in PLAIN_TAGS and not joined):
        return c
    parts = codes if tag[0] == "<" else [tag, *codes]
    return "".join(_plain(chr(int(p, 16))) for p in parts)


@cache
def _tables():
    size = np.ones(TOP, np.int64)
    start = np.empty(TOP, np.int64)
    flat = list(range(TOP))
    start[:] = np.arange(TOP)
    rank = np.zeros(TOP, np.uint8)
    pairs = {}
    for i in range(128, TOP):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if 0x3400 <= i < 0xA000 or i in HANGUL:
            continue  # ideographs and syllables stay
        out = _plain(c)
        if out != c:
            start[i], size[i] = len(flat), len(out)
            flat += map(ord, out)
        rank[i] = unicodedata.combining(c)
        two = unicodedata.decomposition(c).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            a = LOOKALIKES.get(chr(int(two[0], 16)), chr(int(two[0], 16)))
            if a == chr(int(two[0], 16)):
                pairs[(int(two[0], 16) << 21) | int(two[1], 16)] = i
    keys = np.array(sorted(pairs), np.int64)
    return size, start, np.array(flat, np.uint32), rank, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _compose(cp: np.ndarray, rank: np.ndarray, keys: np.ndarray, whole: np.ndarray) -> np.ndarray:
    ccc = rank[np.minimum(cp, TOP - 1)] * (cp < TOP)
    mark = ccc > 0
    if mark.any():
        near = np.flatnonzero(mark)
        seg = np.cumsum(~mark)[near]
        order = np.lexsort((near, ccc[near], seg))  # canonical order of the marks after one base
        cp[near], ccc[near] = cp[near][order], ccc[near][order]
        first = np.searchsorted(seg, seg)
        nth = np.arange(len(near)) - first
        base = near - nth - 1
        alive = np.ones(len(cp), bool)
        last = np.zeros(len(near), np.uint8)  # class of the last mark kept, by the first mark of its base
        ranked = np.argsort(nth, kind="stable")
        bounds = np.searchsorted(nth[ranked], np.arange(int(nth.max()) + 2))
        for k in range(len(bounds) - 1):
            i = ranked[bounds[k] : bounds[k + 1]]
            i = i[base[i] >= 0]
            if not len(i):
                continue
            key = (cp[base[i]].astype(np.int64) << 21) | cp[near[i]].astype(np.int64)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            fits = (keys[at] == key) & (last[first[i]] < ccc[near[i]])
            cp[base[i[fits]]] = whole[at[fits]]
            alive[near[i[fits]]] = False
            last[first[i[~fits]]] = ccc[near[i[~fits]]]
        cp = cp[alive]
    lead = (cp >= 0x1100) & (cp < 0x1113)
    if lead.any():  # Hangul letters become syllables by arithmetic
        i = np.flatnonzero(lead[:-1] & (cp[1:] >= 0x1161) & (cp[1:] < 0x1176))
        cp[i] = 0xAC00 + ((cp[i] - 0x1100) * 21 + (cp[i + 1] - 0x1161)) * 28
        gone = np.zeros(len(cp), bool)
        gone[i + 1] = True
        j = i[i + 2 < len(cp)]
        j = j[(cp[j + 2] > 0x11A7) & (cp[j + 2] < 0x11C3)]
        cp[j] += cp[j + 2] - 0x11A7
        gone[j + 2] = True
        cp = cp[~gone]
    return cp


def _form(cp: np.ndarray) -> np.ndarray:
    """The consistent form of code points with breaks between texts."""
    size, start, flat, rank, keys, whole = _tables()
    low = np.minimum(cp, TOP - 1)
    n = np.where(cp < TOP, size[low], ~((cp >= 0xE0000) & (cp < 0xE01F0)))
    if (n == 1).all():
        out = np.where(cp < TOP, flat[start[low]], cp)
    else:
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        src = np.repeat(cp, n)
        out = np.where(src < TOP, flat[np.minimum(np.repeat(start[low], n) + within, len(flat) - 1)], src)
    return _compose(out.astype(np.uint32), rank, keys, whole)


def _form_of_bytes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the end of each text in them, as bytes and ends of the consistent form."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    out = _form(np.insert(cp, number[ends], BREAK))
    at = np.flatnonzero(out == BREAK)
    width = 1 + (out > 0x7F) + (out > 0x7FF) + (out > 0xFFFF).astype(np.int64)
    width[at] = 0
    done = np.frombuffer(out[out != BREAK].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return done, np.cumsum(width)[at]


def canonical_array(texts: pa.Array) -> pa.Array:
    """The consistent form of an Arrow column of texts."""
    wide = texts.cast(pa.large_string())
    if not len(wide) or wide.buffers()[2] is None:
        return texts.cast(pa.string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8)
    high = np.concatenate(([0], np.cumsum(data[offsets[0] : offsets[-1]] > 0x7F)))
    plain = high[offsets[1:] - offsets[0]] == high[offsets[:-1] - offsets[0]]
    if plain.all():
        return texts.cast(pa.string())
    some = wide.filter(pa.array(~plain))  # nulls have no bytes, so they are plain
    offsets, data = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1], np.frombuffer(some.buffers()[2], np.uint8)
    parts, ends, total, s = [], [np.zeros(1, np.int64)], 0, 0
    while s < len(some):
        e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + SLICE_BYTES, "right")) - 1)
        part, upto = _form_of_bytes(data[offsets[s] : offsets[e]], offsets[s + 1 : e + 1] - offsets[s])
        parts.append(part)
        ends.append(upto + total)
        total += len(part)
        s = e
    new = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(np.concatenate(ends)), pa.py_buffer(np.concatenate(parts)))
    return pc.replace_with_mask(wide, pa.array(~plain), new).cast(pa.string())


def canonical_texts(texts: list[str]) -> list[str]:
    """The consistent form of each text, for small lists."""
    return canonical_array(pa.array(texts, pa.string())).to_pylist()


def canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """`df` with the consistent form of `text` as column `out` (replaced if it exists)."""
    df = df.drop(out) if out in df.columns and out != text else df
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            new = canonical_array(batch.column(text))
            cols = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in cols), new], [*(n for n, _ in cols), out])

    return df.mapInArrow(run, schema)


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, raw): 16-byte hashes of the consistent form and of the characters of every non-null text."""
    made = canonical(df.select(key, text).where(F.col(text).isNotNull()), text, "_form")
    return made.select(key, F.unhex(F.md5("_form")).alias("form"), F.unhex(F.md5(text)).alias("raw"))


def equal_looking(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, raw): hashes of the form and of the characters, for rows whose form has several spellings."""
    seen = written(forms(df, key, text), "forms")
    many = seen.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x != y").select("form")
    return seen.join(many, "form", "left_semi")


def pairs_of_spellings(e: DataFrame, key: str) -> DataFrame:
    """(a, b) for rows of one form with different characters; spellings are paired first, so equal texts are never paired."""
    spelled = e.select("form", "raw").distinct()
    two = pairs_within(spelled, "form", "raw").select(F.col("a").alias("ra"), F.col("b").alias("rb"))  # a spelling has one form
    left = e.select(F.col("raw").alias("ra"), F.col(key).alias("x"))
    right = e.select(F.col("raw").alias("rb"), F.col(key).alias("y"))
    return two.join(left, "ra").join(right, "rb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def p8_found(spark, base) -> DataFrame:
    docs = spark.read.parquet(f"{base}/documents.parquet")
    return pairs_of_spellings(equal_looking(docs), "doc_id").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p8_classes(spark, base) -> DataFrame:
    """One row per document: its form's class (the smallest doc_id of that form) and how many spellings and documents it has."""
    seen = written(forms(spark.read.parquet(f"{base}/documents.parquet"), "doc_id", "text"), "forms")
    spelled = seen.groupBy("form", "raw").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"))
    size = spelled.groupBy("form").agg(F.min("d").alias("class_id"), F.count("*").alias("spellings"), F.sum("n").alias("documents"))
    return seen.join(size, "form").select("doc_id", "class_id", "spellings", "documents")


def p8_texts(spark, base) -> DataFrame:
    """Every document with its text in the consistent form."""
    return canonical(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), "text", "text")
