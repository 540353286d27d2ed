"""Size-checked broadcast of reference tables.

Reference tables (travel-time tables, dictionaries, per-day means) are small
by construction but are computed from large inputs.  They are materialized
once into the shared checkpoint folder, counted, and broadcast only when the
count is within the limit; above it the caller's join falls back to a
shuffle join (sort-merge, with AQE's skew handling)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridecast.session import cut_lineage

BROADCAST_ROW_LIMIT = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT,
                      materialize: bool = True) -> tuple[DataFrame, bool]:
    """(table, broadcast?) — the table materialized and, when its row count is
    within ``max_rows``, marked for broadcast."""
    small = cut_lineage(df) if materialize else df
    n = small.count()
    return (F.broadcast(small), True) if n <= max_rows else (small, False)
