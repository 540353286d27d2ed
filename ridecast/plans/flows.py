"""End-to-end flows as one call each.

* ``forecast``: tickets -> rides with counts -> features (dictionaries fitted
  on train) -> bagged forest -> rounded ``(ride_id, number_of_ticket)`` for the
  rides to score;
* ``daily_travel_times``: the quarterly daily files -> one scan -> date and
  daily mean -> one-year shift of a window -> min-max scaled column;
* ``enrich_rides``: rides left-joined to a per-date table (size-checked
  broadcast), optionally de-duplicated and mean-filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.functions.mathx import half_even
from ridecast.models.ensemble import bag_predict
from ridecast.models.estimators import assemble, random_forest, size_partitions
from ridecast.operators.aggregate import fill_with_mean
from ridecast.operators.enrich import left_join_on, year_shift_union
from ridecast.operators.scale import minmax_scale
from ridecast.plans.rides import RideFeatures, RideSpec
from ridecast.sources.travel import read_daily_files


def forecast(tickets: DataFrame, rides_to_score: DataFrame, spec: RideSpec | None = None,
             cutoff: str | None = None, rare: tuple = (), drop_columns: tuple = ("travel_to", "max_capacity"),
             bags: int = 5, seed: int = 1, n_estimators: int = 100, max_depth: int = 10,
             min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0005, rounded: bool = True,
             label: str = "number_of_tickets", out: str = "number_of_ticket",
             key_as_feature: bool = False) -> DataFrame:
    """Forecast tickets per ride for ``rides_to_score``.

    The dictionaries are fitted on the ticket columns, the forest is refitted
    with ``seed + n`` for ``n`` in ``range(bags)`` and the predictions averaged,
    then rounded half-to-even.  The ride key is kept as key; with
    ``key_as_feature`` it is also a feature (as some of the source's runs do)."""
    spec = spec or RideSpec()
    rf = RideFeatures(spec=spec, label=label, cutoff=cutoff, rare=rare, drop_columns=tuple(drop_columns))
    rf.fit_tickets(tickets)
    train = rf.transform(rf.count_tickets(tickets), train=True)
    score = rf.transform(rides_to_score)
    feats = [c for c in train.columns if c != label and (key_as_feature or c != spec.ride_id)]
    cached = assemble(train, feats).withColumn("label", F.col(label).cast("double")).persist()
    train = size_partitions(cached, cached.count(), spec.ride_id).persist()
    train.count()
    cached.unpersist()
    score = assemble(score.select(*dict.fromkeys([spec.ride_id, *feats])), feats)
    est = lambda s: random_forest(n_estimators=n_estimators, max_depth=max_depth,
                                  min_samples_leaf=min_samples_leaf,
                                  min_impurity_decrease=min_impurity_decrease, seed=s)
    pred = bag_predict(est, train, score, [seed + n for n in range(bags)])
    train.unpersist()
    value = half_even("prediction") if rounded else F.col("prediction")
    return pred.select(spec.ride_id, value.alias(out))


def write_forecast(pred: DataFrame, path: str, single_file: bool = False) -> str:
    """The forecast as a header CSV ``ride_id,number_of_ticket`` (no index
    column).  ``single_file`` gathers it into one file, for a small scoring set
    only; large outputs keep one file per partition."""
    from ridecast.sources.csv_io import write_csv
    return write_csv(pred, path, single_file=single_file)


def daily_travel_times(spark: SparkSession, paths: list[str], after: str | None = None,
                       before: str | None = None, name: str = "city_travel_time",
                       scaled: bool = True) -> DataFrame:
    """Daily files (one scan over all of them) -> (date, daily mean) with the
    rows inside the (after, before) window copied one year ahead; with
    ``scaled`` the measure is min-max scaled into ``<name>_scaled``."""
    daily = read_daily_files(spark, paths).select("date", F.col("daily_mean").alias(name))
    shifted = year_shift_union(daily, ["date"], after=after, before=before)
    if not scaled:
        return shifted
    return minmax_scale(shifted, name, out=f"{name}_scaled", drop_source=True)


def enrich_rides(rides: DataFrame, per_date: DataFrame, ride_date: str = "travel_date",
                 table_date: str = "date", fill: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """Rides left-joined to a per-date table; the table is materialized,
    counted and broadcast when small.  ``fill`` columns get their mean over
    the joined rides where the date had no match."""
    j = left_join_on(rides, per_date, ride_date, table_date, bounded=True, dedupe=dedupe)
    for c in fill or []:
        j = fill_with_mean(j, c)
    return j


def onehot_features(rides: DataFrame, date_col: str = "travel_date", time_col: str | None = "travel_time",
                    origin_col: str = "travel_from", car_col: str = "car_type", rare: tuple = (),
                    bus_value: str = "Bus", origins: list | None = None, other: str = "other") -> DataFrame:
    """The one-hot variant of the ride features: day of month replaces the
    date, the clock gives the hour, rare origins merge into ``other`` (every
    string column), the car type becomes a 0/1 ``car_type_is_bus`` flag and the
    origin becomes one 0/1 column per value (``origins`` fixes the columns, so
    a scoring set can be built with exactly the training columns)."""
    from pyspark.sql.types import StringType

    from ridecast.functions.calendar import parse_date
    from ridecast.functions.clock import clock_hour
    from ridecast.operators.encode import one_hot, rare_to_other
    dt = rides.schema[date_col].dataType
    d = parse_date(date_col) if isinstance(dt, StringType) else F.to_date(date_col)
    out = rides.withColumn("day", F.dayofmonth(d).cast("int")).drop(date_col)
    if time_col:
        out = out.withColumn("hour", clock_hour(time_col)).drop(time_col)
    if rare:
        out = rare_to_other(out, list(rare), other)
    out = out.withColumn("car_type_is_bus", (F.col(car_col) == bus_value).cast("int")).drop(car_col)
    return one_hot(out, origin_col, values=origins)
