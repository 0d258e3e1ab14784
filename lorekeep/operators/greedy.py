"""Order-dependent choices over links, made by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut


def turned_away(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, k): nodes turned away, where in order a node is turned away if an earlier linked one (other) is kept.

    A round keeps the nodes that wait for no other and turns away those linked
    to them; their edges leave.  The smallest node of what is left is always
    settled, so the rounds end.
    """
    edges = cut(edges.distinct())
    out = edges.select(*by, "k").limit(0)
    while edges.limit(1).count():
        kept = edges.select(*by, F.col("other").alias("k")).distinct().join(edges.select(*by, "k"), [*by, "k"], "left_anti")
        gone = cut(edges.join(kept.withColumnRenamed("k", "other"), [*by, "other"], "left_semi").select(*by, "k").distinct())
        edges = cut(edges.join(gone, [*by, "k"], "left_anti").join(gone.withColumnRenamed("k", "other"), [*by, "other"], "left_anti"))
        out = out.union(gone)
    return out
