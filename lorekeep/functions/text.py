"""Text functions as column expressions; they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# File extensions and the kind of document they stand for.
DOC_TYPES = {
    "rs": "Rust source code", "py": "Python source code", "js": "JavaScript source code", "jsx": "JavaScript source code",
    "ts": "TypeScript source code", "tsx": "TypeScript source code", "md": "Markdown documentation", "txt": "Plain text",
    "json": "JSON data", "yaml": "YAML configuration", "yml": "YAML configuration", "toml": "TOML configuration", "html": "HTML document",
    "css": "CSS stylesheet", "sql": "SQL query", "sh": "Shell script", "bash": "Shell script", "pdf": "PDF document",
}
LAYERS = {0: ("flat", None), 1: ("outer", 100), 2: ("middle", 300), 3: ("inner", 600), 4: ("core", None)}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c) -> Column:
    """Runs of white space become one blank, ends are stripped."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def pieces(c) -> Column:
    """The parts between white space, without empty ones."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda x: x != "")


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def short_hash(c) -> Column:
    return F.substring(content_hash(c), 1, 16)


def normal_hash(c) -> Column:
    """Hash of the lower-cased text with collapsed white space."""
    return F.sha2(collapse(F.lower(col(c))), 256)


def slice_id(content, layer: str) -> Column:
    return F.concat(F.lit("slice_"), F.substring(F.sha2(F.concat(col(content), F.lit(layer)), 256), 1, 16), F.lit(f"_{layer}"))


def word_jaccard(a, b) -> Column:
    """Shared different words by all; 1 when neither has any."""
    x, y = F.array_distinct(pieces(a)), F.array_distinct(pieces(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def ascii_lower(c) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def alnum_runs(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), 1)


def keyword_tokens(c) -> Column:
    """Candidate keywords: alphanumeric runs, cut where a capital follows a small letter; a run that was cut also counts whole."""

    def of_run(acc: Column, run: Column) -> Column:
        parts = F.split(ascii_lower(F.regexp_replace(run, "([a-z])([A-Z])", "$1 $2")), " ")
        whole = F.lower(run)
        grown = F.concat(acc, parts)
        wanted = (F.size(parts) > 1) & F.octet_length(whole).between(3, 30) & ~F.array_contains(grown, whole)
        return F.concat(grown, F.when(wanted, F.array(whole)).otherwise(F.array().cast("array<string>")))

    per_word = F.transform(pieces(c), lambda w: F.aggregate(alnum_runs(w), F.array().cast("array<string>"), of_run))
    return F.flatten(per_word)


def session_like(t) -> Column:
    """Tokens that look like ids: long hex, six digits, or long with few letters."""
    t = col(t)
    size = F.octet_length(t)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return ((size > 12) & t.rlike("^[0-9A-Fa-f]+$")) | (digits >= 6) | ((size > 20) & (letters < F.floor(size / 3)))


def cut_words(c, n: int) -> Column:
    """At most n characters, cut at the last blank, with dots when cut."""
    c = col(c)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n), "(?s) [^ ]*$", ""), F.lit("...")))


def token_estimate(c, per_token: float = 3.0) -> Column:
    return F.ceil(F.length(col(c)) / F.lit(per_token)).cast("long")


def safe_chunk_chars(max_tokens: int, per_token: float = 3.0) -> int:
    return int(math.floor(int(max_tokens * 0.8) * per_token))


def file_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path) -> Column:
    """Lower-case ending of the file name behind its last dot; null for none, or for a name that only begins with one."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def doc_type(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])
    return F.try_element_at(table, F.coalesce(extension(path), F.lit("")))


def context_prefix(name, section, kind, most: int = 100) -> Column:
    part = lambda label, c: F.concat(F.lit(f"[{label}: "), col(c), F.lit("]"))
    prefix = F.concat_ws(" ", F.when(col(name) != "", part("Source", name)), part("Section", section), part("Type", kind))
    return F.when(F.octet_length(prefix) > most, F.substring(prefix, 1, most)).otherwise(prefix)


def layer_name(code) -> Column:
    table = F.create_map(*[F.lit(x) for k, (n, _) in LAYERS.items() for x in (k, n)])
    return F.try_element_at(table, col(code).cast("int"))


def first_line(c) -> Column:
    """The first line that isn't blank, with white space collapsed."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), collapse), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def day_count(text: str) -> int:
    """Days of a duration such as 30d, 6m or 1y."""
    if len(text) < 2 or not text[:-1].isdigit() or int(text[:-1]) < 1 or text[-1] not in "dmy":
        raise ValueError(f"no duration: {text!r}")
    return int(text[:-1]) * {"d": 1, "m": 30, "y": 365}[text[-1]]


def fixed_windows(c, size: int = 512, overlap: int = 128) -> Column:
    """Windows of `size` characters every size - overlap, until one reaches the end; the empty text has none."""
    c = col(c)
    step = size - overlap
    n = F.length(c)
    last = F.greatest(F.ceil((n - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
