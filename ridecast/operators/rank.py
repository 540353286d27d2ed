"""Global ordinal positions without a single-task window.

``row_number() over (order by k)`` with no ``partitionBy`` moves every row into
one task.  Here the rows are range-partitioned and sorted by Spark's
distributed sort, each row gets its (partition, position) from
``monotonically_increasing_id``, the sorted frame is checkpointed so that the
assignment is fixed, and a per-partition count table (one row per partition:
bounded by the partition count, never by the data) turns positions into global
0-based ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridecast.session import cut_lineage

_POS_BITS = 33


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank0",
                partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order ``order``
    (and, with ``total``, the row count of the whole frame, from the same
    per-partition table: no second pass over the data).

    ``order`` must be a total order (append a unique key) for the result to be
    deterministic.  The sorted frame is written to the checkpoint folder, which
    also cuts the lineage for whatever consumes the ranks."""
    sorted_df = df.orderBy(*order) if partitions is None else \
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(sorted_df.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid") - F.shiftleft(pid, _POS_BITS)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, never by the data
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("_n")).alias("_off"),
        F.sum("_n").over(whole).alias("_total"))
    out = tagged.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid") \
        .withColumn(name, (F.col("_off") + pos).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_pid", "_off", "_mid", "_total")
