"""Conversations: roles, transcript lines, turns and turn documents.

Turns are islands: a user message opens a new turn if something came before.
A session may hold a third of all messages, so turn numbers are not computed
by a window over a whole session in one task: messages are cut into ranges of
their order first, the openings of the ranges are summed, and each range adds
what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ROLES = {"user": ("user", "human"), "assistant": ("assistant", "bot", "model"), "reasoning": ("reasoning", "analysis", "thinking", "tool")}
SECTIONS = (("user", "User request"), ("assistant", "Assistant response"), ("reasoning", "Reasoning focus"))
MIN_BYTES = 20


def role(c) -> Column:
    """user, assistant or reasoning by the known spellings, null for others."""
    low = X.ascii_lower(X.strip(c))
    out = F.lit(None).cast("string")
    for name, spelled in ROLES.items():
        out = F.when(low.isin(*spelled), F.lit(name)).otherwise(out)
    return out


def header_field(line, key: str) -> Column:
    """A field of a transcript header such as [project: a | agent: b | date: c]."""
    inner = F.regexp_extract(X.strip(line), r"(?s)^\[\s*(project:.*)\]$", 1)
    return F.when(inner != "", F.nullif(X.strip(F.regexp_extract(inner, rf"(?:^| \| ){key}:(.*?)(?: \| |$)", 1)), F.lit("")))


def entry_lines(df: DataFrame, keep: list[str], text: str = "text", headed: bool = False) -> DataFrame:
    """(keep, line, time, role, body) of transcript lines such as [12:30:05] user: text, with the lines that go on.

    Blank lines and the lines of a [signals] block are left out; with `headed`,
    only texts with a transcript header count.
    """
    entry = r"^\s*\[(\d\d:\d\d:\d\d)\]\s*([^:]*):\s*(.*)$"
    if headed:
        df = df.where(F.exists(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\[\s*project:.*\]\s*$")))
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", X.strip("raw"))
    parsed = lines.select(*keep, "line", "raw", F.regexp_extract("raw", entry, 1).alias("time"), role(F.regexp_extract("raw", entry, 2)).alias("role"), F.regexp_extract("raw", entry, 3).alias("body"))
    # the lines of one text are one window; texts are bounded
    order = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("raw") == "[signals]", F.struct("line", F.lit(True).alias("in"))).when(F.col("raw") == "[/signals]", F.struct("line", F.lit(False).alias("in")))).over(order)
    is_entry = F.col("role").isNotNull()
    counted = parsed.withColumns({"n": F.sum(is_entry.cast("int")).over(order), "s": F.coalesce(inside["in"], F.lit(False))})
    opened = counted.where("n > 0").where(is_entry | (~F.col("s") & ~F.col("raw").isin("", "[signals]", "[/signals]")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(is_entry, F.col("body")).otherwise(F.col("raw")).alias("t")))), lambda x: x["t"]), "\n")
    return opened.groupBy(*keep, "n").agg(F.min("line").alias("line"), F.max("time").alias("time"), F.max("role").alias("role"), X.strip(said).alias("body")).drop("n")


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """`df` with the sum of `value` over all rows before in the order of a whole number, in three levels of ranges.

    Only the sums of `width` squared numbers each meet in one task.
    """
    ranged = df.withColumn("_r", F.floor(F.col(order) / width))
    sums = ranged.groupBy("_r").agg(F.sum(value).alias("_s")).withColumn("_q", F.floor(F.col("_r") / width))
    wide = sums.groupBy("_q").agg(F.sum("_s").alias("_t"))
    before = lambda part, by, s: F.sum(s).over(Window.partitionBy(*part).orderBy(by)) - F.col(s)
    wide = wide.select("_q", before((), "_q", "_t").alias("_a"))
    sums = sums.withColumn("_b", before(("_q",), "_r", "_s")).join(wide, "_q").select("_r", (F.col("_a") + F.col("_b")).alias("_c"))
    return ranged.withColumn("_i", before(("_r",), order, value)).join(sums, "_r").withColumn(name, F.col("_c") + F.col("_i")).drop("_r", "_i", "_c")


def numbered(df: DataFrame, session: str, order: str, opens: Column, name: str = "turn", width: int = 4096) -> DataFrame:
    """`df` with the number of openings before or at each row, from 0, in two levels of bounded windows."""
    base = df.withColumn("_o", opens.cast("long")).withColumn("_r", F.floor(F.col(order) / width))
    inner = Window.partitionBy(session, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = base.groupBy(session, "_r").agg(F.sum("_o").alias("_s"))
    before = sums.select(session, "_r", (F.sum("_s").over(Window.partitionBy(session).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_b"))
    joined = base.withColumn("_i", F.sum("_o").over(inner)).join(before, [session, "_r"])
    return joined.withColumn(name, F.col("_b") + F.col("_i")).drop("_o", "_r", "_b", "_i")


def turns(df: DataFrame, session: str = "session_id", order: str = "block_no", text: str = "content", who: str = "role") -> DataFrame:
    """(session, order, role, text, turn): messages of known roles and non-blank text with their turn, counted from 0."""
    told = df.select(session, order, role(who).alias("role"), X.strip(text).alias("text")).where(F.col(session).isNotNull() & F.col("role").isNotNull() & (F.col("text") != ""))
    first = told.groupBy(session).agg(F.min(order).alias("_first"))
    marked = told.join(first, session).withColumn("_open", (F.col("role") == "user") & (F.col(order) != F.col("_first"))).drop("_first")
    return numbered(marked, session, order, F.col("_open")).drop("_open")


def turn_documents(df: DataFrame, session: str = "session_id", order: str = "block_no", text: str = "content", who: str = "role") -> DataFrame:
    """(session, turn, id, content): one document per turn of at least 20 bytes, a section per role.

    A message that repeats the one before of its role in the turn is left out.
    """
    t = turns(df, session, order, text, who)
    prev = F.lag("text").over(Window.partitionBy(session, "turn", "role").orderBy(order))
    said = t.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p") != F.col("text")))
    joined = said.groupBy(session, "turn", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("body"))
    parts = [F.max(F.when(F.col("role") == r, F.concat(F.lit(f"{label}:\n"), "body"))) for r, label in SECTIONS]
    docs = joined.groupBy(session, "turn").agg(F.concat_ws("\n\n", *parts).alias("content")).where(F.octet_length("content") >= MIN_BYTES)
    return docs.withColumn("id", F.concat_ws("-", session, F.lpad(F.col("turn").cast("string"), 4, "0"), X.short_hash("content")))
