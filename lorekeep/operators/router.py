"""Rule-based routing of queries: intent, confidence, secondary intents, hints and search mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words that show an intent.
TEMPORAL = "when date time before after since until ago yesterday today tomorrow last next month week year kiedy data czas przed po wczoraj dzisiaj".split()
STRUCTURAL = "import imports depend depends dependency dependencies call calls reference references use uses module file function class struct interface where defined definition who".split()
SEMANTIC = "similar like related about explain understand meaning concept idea topic theme podobny zwiazany".split()
YEARS = ("2023", "2024", "2025")
RELATIVE = ("yesterday", "today", "last week", "last month", "ago")
RECENT = ("recent", "latest", "newest", "last")
# Mode, keyword weight, vector weight, boost of exact hits per intent.
MODES = {"temporal": ("hybrid", 0.5, 0.5, True), "structural": ("bm25", 0.8, 0.2, True), "semantic": ("vector", 0.1, 0.9, False), "exact": ("bm25", 1.0, 0.0, True), "hybrid": ("hybrid", 0.4, 0.6, False)}
TEMPORAL_SHARE, STRUCTURAL_SHARE = 0.3, 0.4


def _any_in(low: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n)
    return out


def routed(df: DataFrame, query: str = "query", years=YEARS) -> DataFrame:
    """`df` with intent, confidence, secondary, command, date_refs, prefer_recent, mode, weights and boost_exact.

    Lists are joined with commas; a null query has the hybrid intent.
    """
    q = F.coalesce(F.col(query), F.lit(""))
    low = F.lower(q)
    words = X.pieces(low)
    count = lambda of: F.size(F.filter(words, lambda w: w.isin(*of)))
    df = df.withColumns({"_t": count(TEMPORAL), "_s": count(STRUCTURAL), "_m": count(SEMANTIC), "_n": F.greatest(F.size(words), F.lit(1)).cast("double")})
    dashes = F.length(F.regexp_replace(low, "[^-]", ""))
    digits = F.length(F.regexp_replace(low, "[^0-9]", ""))
    dated = _any_in(low, years) | ((dashes >= 2) & (digits >= 4))
    intent = (
        F.when(q.contains('"') | q.contains("'"), "exact")
        .when((F.col("_t") > 0) | dated, "temporal")
        .when((F.col("_s") >= 2) | ((F.col("_s") > 0) & (low.contains("who ") | low.contains("what "))), "structural")
        .when(F.col("_m") > 0, "semantic")
        .otherwise("hybrid")
    )
    df = df.withColumn("intent", intent)
    dense = lambda c: F.least(F.col(c) / F.col("_n") * 2 + 0.3, F.lit(1.0))
    i = F.col("intent")
    confidence = F.when(i == "temporal", dense("_t")).when(i == "structural", dense("_s")).when(i == "semantic", dense("_m")).when(i == "exact", 0.9).otherwise(0.5)
    also_t = (i != "temporal") & (F.col("_t") / F.col("_n") >= TEMPORAL_SHARE)
    also_s = (i != "structural") & (F.col("_s") / F.col("_n") >= STRUCTURAL_SHARE)
    hints = (i == "temporal") | also_t
    refs = F.array_compact(F.array(*[F.when(low.contains(r), F.lit(r)) for r in (*years, *RELATIVE)]))
    mode = lambda at: F.coalesce(*[F.when(i == k, F.lit(v[at])) for k, v in MODES.items()])
    return df.withColumns({
        "confidence": confidence,
        "secondary": F.concat_ws(",", F.when(also_t, "temporal"), F.when(also_s, "structural")),
        "command": F.when(i == "structural", suggested(q, low)),
        "date_refs": F.when(hints, F.array_join(refs, ",")),
        "prefer_recent": F.when(hints, _any_in(low, RECENT)),
        "mode": mode(0), "keyword_weight": mode(1), "vector_weight": mode(2), "boost_exact": mode(3),
    }).drop("_t", "_s", "_m", "_n")


def suggested(q: Column, low: Column) -> Column:
    """What a structure question asks of a code index: kind and target."""
    words = X.pieces(q)
    at = F.array_position(F.transform(words, lambda w: X.ascii_lower(w)), "imports")
    target = F.when(at > 0, F.try_element_at(words, (at + 1).cast("int")))
    rest = F.filter(words, lambda w: ~F.lower(w).isin("where", "is", "the", "defined", "definition", "of"))
    return (
        F.when(low.contains("who imports") | low.contains("what imports"), F.concat(F.lit("who-imports "), F.coalesce(target, F.lit("TARGET"))))
        .when(low.contains("where") & low.contains("defined"), F.concat(F.lit("find "), F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("SYMBOL"))))
        .when(low.contains("depend"), F.lit("impact"))
        .otherwise(F.lit("overview"))
    )
