"""Counts of rows in a time frame before each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_in_frame(df: DataFrame, key: str, day: str, days: int, name: str = "in_frame") -> DataFrame:
    """``df`` with ``name``: how many rows of the same ``key`` fall on the ``days`` days before the row's ``day``, its own
    day left out.

    Rows are counted per key and day first, so the sliding sum runs over days, of which a key has as many as the calendar,
    however many rows it holds; the sums go back to the rows by an equi-join that can split a hot key.  A null key is a
    key; a null day has the count null."""
    per_day = (df.select(F.col(f"`{key}`").alias("k"), F.to_date(F.col(f"`{day}`")).alias("d")).where("d is not null")
               .groupBy("k", "d").agg(F.count("*").alias("n")))
    number = F.unix_date("d").cast("long")
    frame = Window.partitionBy("k").orderBy(number).rangeBetween(-days, -1)
    sums = per_day.select(F.col("k").alias("_k"), F.col("d").alias("_d"), F.coalesce(F.sum("n").over(frame), F.lit(0)).alias(name))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"),
                    F.to_date(F.col(f"`{day}`")).alias("_day"))
    return row.join(sums, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_day") == F.col("_d")), "left").select(
        *[F.col(f"_row.`{c}`") for c in df.columns if c != name], name)
