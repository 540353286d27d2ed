"""Travel-time enrichment: bag unions, year-shifted self-unions, the weekday
band join, the day-of-month left join and the hour-band pick.

Reference tables here are bounded by the calendar (one row per day, per
quarter-weekday or per day of month), not by the ticket volume.  Joins are
written as equi-joins so Spark can hash them: the band join is rewritten from
``dow = dow AND d BETWEEN start AND end`` into an equi-join on the date after
expanding each band to its days, so it never degrades into a nested loop or a
7-key sort-merge join.  Whether the reference side is broadcast is left to
Spark's size checks (``autoBroadcastJoinThreshold`` statically, AQE at runtime
from the materialized size); a hot date on the ride side is split by AQE's skew
join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.functions.calendar import DEFAULT_HOUR_BANDS, add_years
from ridecast.operators.joins import BROADCAST_ROW_LIMIT, bounded_broadcast


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row append with bag semantics, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def year_shift_union(df: DataFrame, date_cols: list[str], after: str | None = None,
                     before: str | None = None, filter_cols: list[str] | None = None,
                     years: int = 1) -> DataFrame:
    """``df`` plus a copy of its rows inside an exclusive window, with every
    column in ``date_cols`` moved ``years`` ahead.  ``filter_cols`` names the
    columns the window is tested on: (first > after) and (last < before).

    Bag semantics of ``df UNION ALL shifted(filter(df))``, computed in one
    pass: each row is emitted once, plus its shifted copy when it is inside
    the window (a generator, so the input is scanned and computed once, not
    once per union branch)."""
    fc = filter_cols or [date_cols[0], date_cols[-1]]
    cond = F.lit(True)
    if after is not None:
        cond = cond & (F.col(fc[0]) > F.lit(after).cast("date"))
    if before is not None:
        cond = cond & (F.col(fc[-1]) < F.lit(before).cast("date"))
    cols = df.columns
    orig = F.struct(*[F.col(f"`{c}`") for c in cols])
    moved = F.struct(*[(add_years(F.col(f"`{c}`"), years) if c in date_cols else F.col(f"`{c}`")).alias(c)
                       for c in cols])
    rows = F.when(F.coalesce(cond, F.lit(False)), F.array(orig, moved)).otherwise(F.array(orig))
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def band_join(rides: DataFrame, bands: DataFrame, date_col: str, dow_col: str,
              start: str = "date_start", end: str = "date_end", band_dow: str = "day_of_week",
              take: list[str] | None = None, how: str = "inner", bounded: bool = True,
              max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Rides joined to every band with the same weekday whose
    [start, end] range contains the ride date (inclusive).

    Each band is expanded to the dates in its range that fall on its weekday,
    so the join is an equi-join on the date: hashable, partitionable and
    skew-splittable.  Bag semantics: overlapping bands fan out.  With
    ``bounded`` the expanded band days are materialized, counted and broadcast
    when within ``max_rows`` (the rides are then never shuffled)."""
    take = take or [c for c in bands.columns if c not in (start, end, band_dow)]
    days = (bands.where(F.col(start) <= F.col(end))
            .select(F.explode(F.sequence(F.col(start), F.col(end))).alias("_band_date"),
                    F.col(band_dow).alias("_band_dow"), *take)
            .where(F.weekday("_band_date") == F.col("_band_dow"))
            .drop("_band_dow"))
    if bounded:
        days, _ = bounded_broadcast(days, max_rows)
    cond = (rides[date_col] == days["_band_date"]) & (rides[dow_col] == F.weekday(days["_band_date"]))
    return rides.join(days, cond, how).drop("_band_date")


def left_join_on(rides: DataFrame, ref: DataFrame, left_key: str, right_key: str | None = None,
                 drop_right_key: bool = True, bounded: bool = False,
                 max_rows: int = BROADCAST_ROW_LIMIT, dedupe: bool = False) -> DataFrame:
    """Left equi-join; with a differently named right key, drop it afterwards.
    With ``bounded`` the reference side is materialized, counted and
    broadcast when within ``max_rows``.  A reference table can repeat a key
    (a date present in two quarterly files), which fans rides out; with
    ``dedupe`` the repeats are merged first (numeric columns averaged, others
    their minimum), one row per key."""
    right_key = right_key or left_key
    if dedupe:
        from pyspark.sql.types import NumericType
        aggs = [(F.avg(f.name) if isinstance(f.dataType, NumericType) else F.min(f.name)).alias(f.name)
                for f in ref.schema.fields if f.name != right_key]
        ref = ref.groupBy(right_key).agg(*aggs)
    if bounded:
        ref, _ = bounded_broadcast(ref, max_rows)
    if right_key == left_key:
        return rides.join(ref, left_key, "left")
    out = rides.join(ref, rides[left_key] == ref[right_key], "left")
    return out.drop(ref[right_key]) if drop_right_key else out


def hour_band_pick(df: DataFrame, hour_col: str, names: dict, bands=DEFAULT_HOUR_BANDS,
                   out=("hour_mean_time", "hour_min_time", "hour_max_time")) -> DataFrame:
    """Pick the (mean, lower, upper) triple of the band the hour falls in.

    ``names`` maps a band name to its three source columns.  Hours outside
    every band give nulls."""
    h = F.col(hour_col)
    picks = []
    for i in range(3):
        expr: Column | None = None
        for band, lo, hi in bands:
            cond = (h >= lo) & (h < hi)
            src = F.col(names[band][i])
            expr = F.when(cond, src) if expr is None else expr.when(cond, src)
        picks.append(expr.alias(out[i]))
    return df.select("*", *picks)
