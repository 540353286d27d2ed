"""Column scaling with global statistics.

The statistics are one-row aggregates (partial + final aggregation), joined
back by a broadcast whose size is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std, per column (MLlib's scaler uses n - 1).  A constant column becomes 0, null stays."""
    stats = df.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_mu_{c}"))
                             / F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}")))
    return out.drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def minmax_scale(df: DataFrame, col: str, out: str | None = None, drop_source: bool = False) -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; a constant column maps to 0, null stays."""
    out = out or col
    stats = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.col(col).isNull(), F.lit(None)).when(span == 0, F.lit(0.0)).otherwise(
        (F.col(col) - F.col("_lo")) / span).cast("double")
    res = df.crossJoin(F.broadcast(stats)).withColumn(out, scaled).drop("_lo", "_hi")
    if drop_source and out != col:
        res = res.drop(col)
    return res
