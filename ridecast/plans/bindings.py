"""How the driver's tables stand in for the ride data.

* tickets  = ``lineitem`` rows: ride id ``l_orderkey``, travel date
  ``l_shipdate``, origin ``l_returnflag``, car type ``l_linestatus``,
  capacity ``l_linenumber``;
* rides    = ``orders``: ride id ``o_orderkey``, travel date ``o_orderdate``,
  origin ``o_orderpriority``, car type ``o_orderstatus``; the label is the
  number of ``lineitem`` rows per order (tickets per ride);
* shared rides = ``lineitem`` rows again, several to a ride: ride id ``l_suppkey / 4``, travel date the
  first day of the quarter of ``l_shipdate``, clock and capacity from ``l_linenumber`` and ``l_quantity``;
* clock times come from ``events.ts`` rendered as ``H:mm`` text;
* travel-time tables are derived from ``lineitem`` (see sources/travel.py).

Each loader selects only the columns it needs, so the parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.functions.clock import clock_text
from ridecast.operators.aggregate import counts_per_key
from ridecast.sources.tables import load

# Fixed values of the stand-in binding (parameters of the queries, not tuned).
TRAIN_CUTOFF = "1995-04-01"          # rides before it are dropped from training
SCORE_FROM = "1999-01-01"            # rides on/after it form the scoring set
RARE_ORIGINS = ("R",)                # origins merged into "other" (lineitem binding)
RARE_PRIORITIES = ("4-NOT SPECIFIED", "5-LOW")   # merged into "other" (orders binding)
SHIFT_AFTER = "1999-06-30"           # daily rows strictly after ...
SHIFT_BEFORE = "2000-01-01"          # ... and strictly before are copied one year ahead
BAND_SHIFT_AFTER = "1999-06-29"      # quarter bands starting after ...
BAND_SHIFT_BEFORE = "2000-01-01"     # ... and ending before are copied one year ahead


def tickets(spark: SparkSession, d: str, with_capacity: bool = False) -> DataFrame:
    li = load(spark, d, "lineitem")
    cols = [F.col("l_orderkey").alias("ride_id"), F.col("l_shipdate").alias("travel_date"),
            F.col("l_returnflag").alias("travel_from"), F.col("l_linestatus").alias("car_type")]
    if with_capacity:
        cols.append(F.col("l_linenumber").cast("int").alias("max_capacity"))
    return li.select(*cols)


def rides(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("ride_id"), F.col("o_orderdate").alias("travel_date"),
                    F.col("o_orderpriority").alias("travel_from"), F.col("o_orderstatus").alias("car_type"))


def labelled_rides(spark: SparkSession, d: str, label: str = "number_of_tickets", how: str = "inner") -> DataFrame:
    """Rides with their ticket count.  Tickets are counted on the ride key first
    (map-side partial aggregation, one shuffled row per partition and order),
    then joined to the rides table on the same key."""
    counts = counts_per_key(load(spark, d, "lineitem"), "l_orderkey", label) \
        .withColumnRenamed("l_orderkey", "ride_id")
    return rides(spark, d).join(counts, "ride_id", how)


def train_rides(spark: SparkSession, d: str) -> DataFrame:
    return labelled_rides(spark, d).where(F.col("travel_date") < F.lit(SCORE_FROM).cast("timestamp_ntz"))


def score_rides(spark: SparkSession, d: str) -> DataFrame:
    """All rides to forecast (their true counts kept aside as ``actual``, null for a ride without tickets)."""
    return labelled_rides(spark, d, how="left").where(
        F.col("travel_date") >= F.lit(SCORE_FROM).cast("timestamp_ntz")).withColumnRenamed("number_of_tickets", "actual")


def clock_rides(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    return ev.select(F.col("event_id").alias("ride_id"), F.col("ts"), clock_text("ts").alias("travel_time"))


def shared_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets of which several share a ride, with a clock and a capacity."""
    li = load(spark, d, "lineitem")
    return li.select(
        F.floor(F.col("l_suppkey") / 4).alias("ride_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("travel_date"),
        F.concat((F.col("l_linenumber") % 2 * 7 + 6).cast("string"), F.lit(":05")).alias("travel_time"),
        F.col("l_returnflag").alias("travel_from"), F.col("l_linestatus").alias("car_type"),
        F.when(F.col("l_quantity") >= 25, 49).otherwise(11).alias("max_capacity"))
