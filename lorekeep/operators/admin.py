"""Administration of the corpus: quality, overviews, duplicates, timelines, garbage, merging and recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import meta as M
from ..functions import text as X
from .store import orphans

GRADES = ((0.95, "EXCELLENT"), (0.90, "GOOD"), (0.70, "WARN"))
SALTS = 64


def quality(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Text integrity per group: sentences, words, chunk sizes and the grade.

    A sum of row values only, so each task sends one row per group.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    ends = F.length(c) - F.length(F.regexp_replace(c, "[.!?]", ""))
    stripped = X.strip(c)
    whole = F.when(stripped == "", 0).when(stripped.rlike(r"""[.!?:"')\]]$"""), ends).otherwise(F.greatest(ends - 1, F.lit(0)))
    word = (stripped == "") | stripped.rlike(r"""[!-/:-@\[-`{-~]$""")
    size = F.octet_length(c)
    sums = df.groupBy(group).agg(
        F.count("*").alias("chunks"), F.sum(ends.cast("long")).alias("_e"), F.sum(whole.cast("long")).alias("_w"),
        F.avg(word.cast("double")).alias("word_integrity"), F.avg(size.between(200, 800).cast("double")).alias("chunk_quality"), F.floor(F.sum(size.cast("long")) / F.count("*")).cast("long").alias("avg_chunk_length"),
    )
    sentence = F.when(F.col("_e") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_w") / F.col("_e")))
    out = sums.withColumn("sentence_integrity", sentence)
    out = out.withColumn("overall", 0.5 * F.col("sentence_integrity") + 0.3 * F.col("word_integrity") + 0.2 * F.col("chunk_quality")).drop("_e", "_w")
    grade = F.lit("PURGE")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("overall") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def without_poor(df: DataFrame, group: str, text: str, threshold: float) -> DataFrame:
    """Rows of groups at or over the threshold."""
    poor = quality(df, group, text).where(F.col("overall") < threshold).select(group)
    return df.join(poor, group, "left_anti")


def top_keywords(df: DataFrame, group: str, keywords: str = "keywords", most: int = 10) -> DataFrame:
    """(group, rank, keyword, n): the most frequent stored keywords per group."""
    n = df.select(group, F.explode(M.string_array(keywords)).alias("keyword")).groupBy(group, "keyword").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "keyword"))).where(F.col("rank") <= most)


def overview(df: DataFrame) -> DataFrame:
    """Per namespace: rows, rows per layer, whether any has a time, and the first and last time text."""
    when = M.first_present(M.parsed())
    layers = [F.sum((F.coalesce("layer", F.lit(0)) == code).cast("long")).alias(name) for code, (name, _) in X.LAYERS.items()]
    return df.withColumn("_t", when).groupBy("namespace").agg(F.count("*").alias("total"), *layers, F.bool_or(F.col("_t").isNotNull()).alias("has_times"), F.min("_t").alias("first_time"), F.max("_t").alias("last_time"))


def duplicates(df: DataFrame, within: list[str], order: list[Column]) -> DataFrame:
    """Rows with the number of their copy (1 is kept) among those of one hash; rows without a hash are left out.

    Hot hashes are numbered in two steps: each of SALTS parts of a hash finds
    its first row, and only those meet; every other row is a copy whatever its
    number.
    """
    keyed = df.where(F.col("content_hash").isNotNull()).withColumn("_s", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)))
    by = [*within, "content_hash"]
    local = keyed.withColumn("_l", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order)))
    heads = local.where("_l = 1").withColumn("_h", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rest = local.where("_l > 1").withColumn("_h", F.lit(None).cast("int"))
    return heads.unionByName(rest).withColumn("kept", F.coalesce(F.col("_h") == 1, F.lit(False))).drop("_s", "_l", "_h")


def duplicate_report(df: DataFrame, within: list[str]) -> DataFrame:
    """One row: rows, rows without a hash, different hashes, groups of copies and rows to remove."""
    by = [*within, "content_hash"]
    g = df.groupBy(*by).agg(F.count("*").alias("n"))
    has = F.col("content_hash").isNotNull()
    return g.agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("without_hash"), F.sum(has.cast("long")).alias("unique_hashes"),
        F.sum((has & (F.col("n") > 1)).cast("long")).alias("duplicate_groups"), F.coalesce(F.sum(F.when(has, F.col("n") - 1)), F.lit(0)).alias("removable"),
    )


def collapsed(records: DataFrame, order: str = "rec_no") -> DataFrame:
    """One record per family of an export: the longest text, then the deepest layer, then the first; with the size of the family."""
    v = M.parsed()
    blank = lambda c: F.nullif(X.strip(c), F.lit(""))
    owner = F.coalesce(blank(M.text_value(v, "original_id")), blank(M.text_value(v, "doc_id")), F.col("id"))
    depth = F.coalesce(F.try_variant_get(v, "$.layer", "int"), F.lit(0))
    best = F.max_by(F.struct(order, "id", "text"), F.struct(F.octet_length("text"), depth, -F.col(order)))
    return records.where(F.col("text").isNotNull()).withColumn("family", owner).groupBy("namespace", "family").agg(best.alias("b"), F.count("*").alias("members")).select("namespace", "family", "b.*", "members")


def timeline(df: DataFrame) -> DataFrame:
    """(day, namespace, source, n): rows by the day of their time text, namespace and source file; unknown where there is none."""
    v = M.parsed()
    day = F.coalesce(F.substring_index(M.text_value(v, "indexed_at"), "T", 1), F.lit("unknown"))
    source = X.file_name(F.coalesce(M.text_value(v, "path"), F.lit("unknown")))
    return df.groupBy(F.substring_index(day, " ", 1).alias("day"), "namespace", source.alias("source")).agg(F.count("*").alias("n"))


def days(df: DataFrame) -> DataFrame:
    """(day): the different known days of a timeline."""
    return timeline(df).select(F.to_date(F.when(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$"), F.col("day"))).alias("day")).where("day is not null").distinct()


def coverage(d: DataFrame) -> DataFrame:
    return d.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span_days"))


def gaps(d: DataFrame) -> DataFrame:
    """(after_day, next_day, missing): holes between known days; days are few, so one window serves."""
    w = Window.orderBy("day")
    return d.withColumn("after_day", F.lag("day").over(w)).where(F.datediff("day", "after_day") > 1).select("after_day", F.col("day").alias("next_day"), (F.datediff("day", "after_day") - 1).cast("long").alias("missing"))


def old_rows(df: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose first time text lies before the cutoff; a text that can't be read keeps its row."""
    return df.where(M.timestamp(M.first_present(M.parsed())) < F.lit(cutoff).cast("timestamp"))


def garbage(df: DataFrame, cutoff: str) -> DataFrame:
    """(finding, namespace, n): orphans and old rows per namespace."""
    parts = [orphans(df).groupBy("namespace").agg(F.count("*").alias("n")).withColumn("finding", F.lit("orphan")), old_rows(df, cutoff).groupBy("namespace").agg(F.count("*").alias("n")).withColumn("finding", F.lit("old"))]
    return reduce(DataFrame.unionByName, parts).select("finding", "namespace", "n")


def merged(sources: list[DataFrame], prefix: str | None = None) -> DataFrame:
    """Rows of several stores in order, with `source` (from 0) and `copied`: false for rows whose hash an earlier row has."""
    tagged = [d.withColumn("source", F.lit(i)) for i, d in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged)
    if prefix:
        every = every.withColumn("namespace", F.concat(F.lit(prefix), "namespace"))
    hashed = every.where(F.col("content_hash").isNotNull())
    first = hashed.groupBy("content_hash").agg(F.min(F.struct("source", "row_no")).alias("_f"))
    settled = hashed.join(first, "content_hash").withColumn("copied", F.struct("source", "row_no") == F.col("_f")).drop("_f")
    # rows without a hash meet nothing, so they don't go through the join
    return settled.unionByName(every.where(F.col("content_hash").isNull()).withColumn("copied", F.lit(True)))


def migrated(df: DataFrame, source: str, target: str, delete_source: bool = False, merge: bool = False) -> DataFrame:
    """The store with the rows of one namespace under another; an existing target needs `merge`."""
    if not merge and df.where(F.col("namespace") == target).limit(1).count():
        raise ValueError(f"namespace {target!r} exists")
    moved = df.where(F.col("namespace") == source).withColumn("namespace", F.lit(target))
    return (df.where(~F.col("namespace").eqNullSafe(source)) if delete_source else df).unionByName(moved)


def recovery(ledger: DataFrame, vectors: DataFrame, keywords: DataFrame) -> DataFrame:
    """The state of each batch of a write ledger (batch_id, status, namespace, id): divergent, rolled_back, stale or clean."""
    v = vectors.select("namespace", "id").distinct().withColumn("v", F.lit(1))
    k = keywords.select("namespace", "id").distinct().withColumn("k", F.lit(1))
    seen = ledger.join(v, ["namespace", "id"], "left").join(k, ["namespace", "id"], "left")
    n = lambda c: F.sum(c.cast("long"))
    has_v, has_k = F.col("v").isNotNull(), F.col("k").isNotNull()
    counted = seen.groupBy("batch_id", "status").agg(F.count("*").alias("documents"), n(has_v).alias("in_vectors"), n(has_v & has_k).alias("in_keywords"), n(has_v & ~has_k).alias("missing_keywords"), n(~has_v).alias("missing_vectors"))
    state = F.when(F.col("missing_keywords") > 0, "divergent").when(F.col("status") == "rolled_back", "rolled_back").when((F.col("missing_vectors") > 0) | (F.col("in_vectors") == 0), "stale").otherwise("clean")
    return counted.withColumn("state", state)


def smoothed(daily: DataFrame, day: str, value: str, weight: float = 0.3) -> DataFrame:
    """(day, ema): exponential means of one value a day, in order; the days are few, so one task folds them."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(day)
        out, last = [], None
        for v in t.column(value).to_pylist():
            last = v if last is None else weight * v + (1 - weight) * last
            out.append(last)
        return pa.table([t.column(day), pa.array(out, pa.float64())], [day, "ema"])

    return daily.select(day, value).groupBy(F.lit(0).alias("_all")).applyInArrow(run, f"{day} {daily.schema[day].dataType.simpleString()}, ema double")


def rolling_rate(events: DataFrame, group: str, ts: str, order: str, width: int = 50) -> DataFrame:
    """`events` with the completions per second over the last `width` of their group."""
    w = Window.partitionBy(group).orderBy(ts, order).rowsBetween(1 - width, 0)
    span = F.unix_micros(F.max(ts).over(w)) - F.unix_micros(F.min(ts).over(w))
    return events.withColumn("rate", F.when(span > 0, (F.count("*").over(w) - 1) / (span / 1e6)))
