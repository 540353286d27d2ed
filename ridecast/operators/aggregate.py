"""Grouped counts and means.

Every grouped aggregate here is a hash aggregate with a map-side partial step,
so the shuffle carries one row per (partition, group) however many rows a hot
group holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def ride_counts(tickets: DataFrame, keys: list[str], name: str = "number_of_tickets",
                drop_null_keys: bool = True) -> DataFrame:
    """Tickets per ride: one row per distinct key tuple with its row count.

    Rows with a null in any key are dropped first (a pandas group-by drops such
    groups; Spark would keep them as their own group)."""
    src = tickets.dropna(subset=list(keys)) if drop_null_keys else tickets
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def counts_below(counts: DataFrame, col: str, below: int) -> DataFrame:
    """Post-aggregate filter (SQL HAVING): keep groups whose count is under ``below``."""
    return counts.where(F.col(col) < below)


def counts_per_key(tickets: DataFrame, key: str, name: str = "number_of_tickets") -> DataFrame:
    """Pre-aggregation of tickets on the ride key alone.  When the ride
    attributes live in a separate rides table, counting first and joining the
    rides afterwards shuffles one row per (partition, ride) instead of every
    ticket."""
    return tickets.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def day_of_month_mean(df: DataFrame, date_col: str = "date", drop=(), day_name: str = "day") -> DataFrame:
    """Mean of every remaining numeric column per day of month (1..31).
    Mixes months on purpose: a ride on the 5th gets the mean of all 5ths."""
    measures = numeric_columns(df, exclude=set(drop) | {date_col})
    return df.groupBy(F.dayofmonth(date_col).cast("int").alias(day_name)).agg(
        *[F.avg(c).alias(c) for c in measures])


def fill_with_mean(df: DataFrame, col: str) -> DataFrame:
    """Nulls of ``col`` -> the column's mean over ``df``.  The mean is a one-row
    aggregate, so the broadcast is bounded by construction."""
    mean = df.agg(F.avg(col).alias("_fill_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(col, F.coalesce(F.col(col), F.col("_fill_mean"))) \
        .drop("_fill_mean")
