"""Cleaning of chat exports by patterns, and filters for messages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .durable import written
from .greedy import turned_away
from .pairs import pairs_within
from .parallel import busy

# Patterns of noise, in the order they are removed.  (?d) makes only \n a line end.
_TAG = lambda name: rf"(?s)<{name}>.*?</{name}>"
_CALL = lambda name: rf"(?s)<antml:{name}[^>]*>.*?</antml:{name}>"
TOOL_BLOCKS = (_TAG("function_calls"), _CALL("invoke"), _CALL("parameter"), _TAG("function_results"), _TAG("result"))
TOOL_TAGS = r"(?s)<(output|name|value)>.*?</(output|name|value)>"
CLI = (
    r"^\s*(On branch|Your branch|Changes (?:not staged|to be committed)|Untracked files|nothing to commit|modified:|new file:|deleted:).*$",
    r"^(diff --git|index [0-9a-f]+\.\.[0-9a-f]+|--- a/|--- /|\+\+\+ a/|\+\+\+ b/|@@\s*-\d+.*@@|Binary files).*$",
    r"^(\s*(Compiling|Finished|Running|warning:|error\[E|-->|note:|help:)).*$",
    r"^(npm (WARN|ERR!|notice)|added \d+ packages|up to date|audited \d+ packages).*$",
    r"^(total \d+|[drwx-]{10}\s+\d+|[-lrwx]{10}\s+\d+).*$",
    r"^[│├└─\s]+[\w.-]+/?$",
)
METADATA = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[UUID]"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "[TIMESTAMP]"),
    (r"\b1[6-7]\d{8}\b", "[TIMESTAMP]"),
    (r"""(session_id|sessionId|session-id|conv_id|conversation_id)["']?\s*[:=]\s*["']?[\w-]+""", ""),
    (r'"(path|file_path|filepath)"\s*:\s*"[^"]+"', ""),
)
EMPTY = (r'"content"\s*:\s*\[\s*\]', r'"text"\s*:\s*""', r"(?i)(placeholder|lorem ipsum|TODO:|FIXME:|XXX:)")
MIN_BYTES, NEAR = 50, 0.95


def _gone(c: Column, patterns) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def cleaned(text, tools: bool = True, cli: bool = True, metadata: bool = False, empty: bool = True) -> Column:
    """The text without noise; white space is reduced and the ends are stripped."""
    c = X.col(text)
    if tools:
        c = _gone(c, (*TOOL_BLOCKS, TOOL_TAGS))
    if cli:
        c = _gone(c, ["(?md)" + p for p in CLI])
    if metadata:
        for p, new in METADATA:
            c = F.regexp_replace(c, p, new)
    if empty:
        c = _gone(c, EMPTY)
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " ")
    return X.strip(c)


def mostly_tools(text) -> Column:
    """Over four fifths of the bytes are tool blocks."""
    c = X.col(text)
    size = F.octet_length(c)
    return (size > 0) & (1 - F.octet_length(X.strip(_gone(c, TOOL_BLOCKS))) / size > 0.8)


def mostly_cli(text) -> Column:
    """Over seven tenths of the lines are command output."""
    c = X.col(text)
    lines = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, "\n$", ""), "\n"))
    hits = F.size(F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in CLI))))
    return (F.size(lines) > 0) & (hits / F.size(lines) > 0.7)


def kept_messages(df: DataFrame, text: str = "content", order: str = "block_no") -> DataFrame:
    """Messages that are long enough once cleaned, the first of each normal form in order of arrival."""
    c = busy(df).withColumn("clean", cleaned(text)).where(F.octet_length("clean") >= MIN_BYTES)
    # the first per hash by an aggregate: partial sums keep hot texts from meeting in one task
    first = c.groupBy(X.normal_hash("clean").alias("hash")).agg(F.min_by(F.struct(order, "clean"), F.col(order)).alias("m"))
    return first.select("m.*", "hash")


def drop_reason(text: str = "content") -> Column:
    """Why a message is dropped before duplicates are looked for; null if it isn't."""
    clean = cleaned(text)
    return (
        F.when(mostly_tools(text), "tool_artifact")
        .when(mostly_cli(text), "cli_output")
        .when(X.strip(clean) == "", "empty")
        .when(F.octet_length(clean) < MIN_BYTES, "below_min_length")
    )


def filtered_conversations(df: DataFrame, session: str = "session_id", order: str = "block_no", text: str = "content", near: float = NEAR) -> DataFrame:
    """(session, order, clean, reason): every message with its cleaned text and why it is dropped.

    Messages at the word similarity `near` to an earlier kept one of their
    session are near duplicates.  Exact repeats are settled first, by a window,
    as a copy of a message shares its fate.  For the rest, word sets that
    similar have sizes in proportion and share a rare word among their first
    ones (prefix filter), so candidates come from a join on such words, in cells
    of bounded size, and the greedy choice is made on the links by rounds.
    """
    # cleaned once, as it is read for the sets, for both sides of the links and for the result
    base = written(busy(df.where(F.col(text).isNotNull()).select(session, order, text)).select(session, order, cleaned(text).alias("clean"), drop_reason(text).alias("reason")), "cleaned")
    kept = base.where("reason is null").select(F.col(session).alias("s"), F.col(order).alias("o"), "clean")
    words = F.array_sort(F.array_distinct(X.pieces("clean")))
    sets = kept.select("s", "o", words.alias("w"))
    firsts = sets.groupBy("s", "w").agg(F.min("o").alias("o"))
    sized = firsts.select("s", "o", "w", F.size("w").alias("n"))
    # any order common to all sets serves the prefix filter; long words come first, as they are rare
    ordered = F.transform(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("l"), F.xxhash64(x).alias("h")))), lambda x: x["h"])
    # a pair shares at least near * (larger size) words, so one lies among the first n - ceil(near * n) + 1 of each
    prefix = F.slice(ordered, F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(near)) + 1).cast("int"))
    keys = sized.select("s", "o", "n", F.explode(prefix).alias("x"))
    keys = keys.select(F.xxhash64("s", "x").alias("key"), F.struct("o", "s").alias("id"), "n")
    alike = lambda a, b: (a["id"]["s"] == b["id"]["s"]) & (F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * near)
    pairs = pairs_within(keys, "key", "id", alike, ("n",)).distinct().select(F.col("a.s").alias("s"), F.col("a.o").alias("other"), F.col("b.o").alias("k"))
    l_, r_ = sized.select("s", F.col("o").alias("other"), F.col("w").alias("wa")), sized.select("s", F.col("o").alias("k"), F.col("w").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    edges = pairs.join(l_, ["s", "other"]).join(r_, ["s", "k"]).where(shared >= near * (F.size("wa") + F.size("wb") - shared)).select("s", "k", "other")
    gone = turned_away(edges, ["s"])
    reps = sets.join(firsts.select("s", "w", F.col("o").alias("first")), ["s", "w"]).select("s", "o", "first")
    repeat = reps.join(gone.select("s", F.col("k").alias("first"), F.lit(True).alias("g")), ["s", "first"], "left").where((F.col("o") != F.col("first")) | F.col("g").isNotNull()).select("s", "o", F.lit("near_duplicate").alias("why"))
    out = base.join(repeat, (base[session].eqNullSafe(repeat["s"])) & (base[order] == repeat["o"]), "left")
    return out.select(base[session], base[order], "clean", F.coalesce("reason", "why").alias("reason"))


def first_of(df: DataFrame, by: list, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")
