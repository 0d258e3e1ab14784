"""Work for all cores where the input is small."""

from __future__ import annotations

from pyspark.sql import DataFrame


TASK_BYTES = 16 << 20


def busy(df: DataFrame) -> DataFrame:
    """`df` for work that costs more time than bytes: inputs that are estimated at less than TASK_BYTES a core are dealt out, others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * TASK_BYTES else df
