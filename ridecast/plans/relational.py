"""Exact operators with DuckDB oracles.

Each query reads the driver's tables (or frames Spark derives from them) and
returns a DataFrame whose column names and types match its oracle SQL.
Doubles that come out of averages or divisions are rounded to 6 digits on both
sides; date parts are INT and counts BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridecast.functions.calendar import (
    day_part, iso_week, parse_date, weekday, weekday_from_name, weekend_flag,
)
from ridecast.functions.clock import clock_hour, clock_minute, time_to_minutes
from ridecast.functions.mathx import floor_rule, half_even, threshold_label
from ridecast.operators.aggregate import counts_below, counts_per_key, day_of_month_mean, fill_with_mean, ride_counts
from ridecast.operators.encode import (
    CategoryCodes, align_columns, auto_features, encode_all_strings, one_hot, rare_to_other,
)
from ridecast.operators.enrich import band_join, hour_band_pick, left_join_on, year_shift_union
from ridecast.operators.joins import bounded_broadcast
from ridecast.operators.folds import holdout_split, kfold_ntile, kfold_stratified
from ridecast.operators.metrics import regression_metrics
from ridecast.operators.scale import minmax_scale, standard_scale
from ridecast.plans import bindings as B
from ridecast.plans.registry import query
from ridecast.plans.rides import RideFeatures, RideSpec
from ridecast.session import cut_lineage, scratch_path
from ridecast.sources.csv_io import read_csv, write_csv
from ridecast.sources.tables import load
from ridecast.sources.travel import (
    BAND_KEYS, BAND_LINE, ID_COLUMNS, MEASURE_COLUMNS, daily_travel_times, parse_date_range,
    read_daily_files, weekday_travel_times, write_daily_files,
)


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# shared oracle fragments (DuckDB)
# --------------------------------------------------------------------------

def _daily_sql() -> str:
    x = "l_extendedprice"
    parts = [f"CAST(floor(avg({x})) AS INTEGER) AS daily_mean",
             f"CAST(floor(min({x})) AS INTEGER) AS daily_lower",
             f"CAST(floor(max({x})) AS INTEGER) AS daily_upper"]
    for k in BAND_KEYS[1:]:
        sel = f"CASE WHEN l_linenumber = {BAND_LINE[k]} THEN {x} END"
        parts += [f"CAST(floor(avg({sel})) AS INTEGER) AS {k}_mean",
                  f"CAST(floor(min({sel})) AS INTEGER) AS {k}_lower",
                  f"CAST(floor(max({sel})) AS INTEGER) AS {k}_upper"]
    return ("SELECT CAST(l_shipdate AS DATE) AS date, " + ", ".join(parts)
            + " FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")


DAILY_SQL = _daily_sql()

WEEKDAY_BANDS_SQL = """
SELECT q_start, CAST(last_day(q_start + INTERVAL 2 MONTH) AS DATE) AS q_end, dow,
       mean_travel_day, lower_travel_day, upper_travel_day
FROM (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q_start,
             CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dow,
             CAST(floor(avg(l_extendedprice)) AS INTEGER) AS mean_travel_day,
             CAST(floor(min(l_extendedprice)) AS INTEGER) AS lower_travel_day,
             CAST(floor(max(l_extendedprice)) AS INTEGER) AS upper_travel_day
      FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)
"""

# weekday bands after the one-year shift of the second half of 1999
SHIFTED_BANDS_SQL = f"""
WITH wb AS ({WEEKDAY_BANDS_SQL}),
b AS (SELECT dow AS day_of_week, q_start AS date_start, q_end AS date_end,
             mean_travel_day, lower_travel_day, upper_travel_day FROM wb)
SELECT * FROM b
UNION ALL
SELECT day_of_week, CAST(date_start + INTERVAL 1 YEAR AS DATE), CAST(date_end + INTERVAL 1 YEAR AS DATE),
       mean_travel_day, lower_travel_day, upper_travel_day
FROM b WHERE date_start > DATE '{B.BAND_SHIFT_AFTER}' AND date_end < DATE '{B.BAND_SHIFT_BEFORE}'
"""

SHIFTED_DAILY_SQL = f"""
WITH d AS (SELECT date, daily_mean AS city_travel_time FROM ({DAILY_SQL}))
SELECT date, city_travel_time FROM d
UNION ALL
SELECT CAST(date + INTERVAL 1 YEAR AS DATE), city_travel_time FROM d
WHERE date > DATE '{B.SHIFT_AFTER}' AND date < DATE '{B.SHIFT_BEFORE}'
"""


def _spark_weekday_bands(spark: SparkSession, d: str) -> DataFrame:
    """Weekday table as files hold it, parsed: weekday index from its name,
    range text into start / end dates, then the one-year shift self-union."""
    wk = parse_date_range(weekday_travel_times(load(spark, d, "lineitem")))
    wk = wk.select(weekday_from_name("day_of_week_name").alias("day_of_week"), "date_start", "date_end",
                   "mean_travel_day", "lower_travel_day", "upper_travel_day")
    bands = year_shift_union(wk, ["date_start", "date_end"], after=B.BAND_SHIFT_AFTER,
                             before=B.BAND_SHIFT_BEFORE)
    # 7 rows per quarter (+ shifted copies): materialized once, so the join
    # reads a tiny table and no band predicate is pushed into the ticket scan
    return cut_lineage(bands)


def _spark_shifted_daily(spark: SparkSession, d: str, materialize: bool = False) -> DataFrame:
    """Daily mean travel time plus its one-year-shifted slice.  With
    ``materialize`` the (calendar-bounded) table is written once, for callers
    that read it more than once (statistics, then rows)."""
    daily = daily_travel_times(load(spark, d, "lineitem")).select(
        "date", F.col("daily_mean").alias("city_travel_time"))
    out = year_shift_union(daily, ["date"], after=B.SHIFT_AFTER, before=B.SHIFT_BEFORE)
    return cut_lineage(out) if materialize else out


# --------------------------------------------------------------------------
# flagship: ride features (fit on train tickets)
# --------------------------------------------------------------------------

RIDE_FEATURES_SQL = f"""
WITH t AS (
  SELECT l_orderkey AS ride_id, l_shipdate AS travel_date, l_returnflag AS travel_from, l_linestatus AS car_type
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{B.TRAIN_CUTOFF}'),
c AS (
  SELECT ride_id, travel_date, travel_from, car_type, count(*) AS number_of_tickets FROM t
  WHERE ride_id IS NOT NULL AND travel_date IS NOT NULL AND travel_from IS NOT NULL AND car_type IS NOT NULL
  GROUP BY ride_id, travel_date, travel_from, car_type),
m AS (
  SELECT ride_id, CAST(travel_date AS DATE) AS d,
         CASE WHEN travel_from IN ('R') THEN 'other' ELSE travel_from END AS travel_from,
         CASE WHEN car_type IN ('R') THEN 'other' ELSE car_type END AS car_type,
         number_of_tickets FROM c),
tf AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT travel_from AS v FROM m WHERE travel_from IS NOT NULL)),
ct AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT car_type AS v FROM m WHERE car_type IS NOT NULL))
SELECT m.ride_id, CAST(isodow(d) - 1 AS INTEGER) AS travel_date,
       CAST(COALESCE(tf.code, -1) AS INTEGER) AS travel_from, CAST(COALESCE(ct.code, -1) AS INTEGER) AS car_type,
       m.number_of_tickets, CAST(month(d) AS INTEGER) AS month, CAST(weekofyear(d) AS INTEGER) AS week,
       CASE WHEN isodow(d) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM m LEFT JOIN tf ON m.travel_from = tf.v LEFT JOIN ct ON m.car_type = ct.v
"""


def ride_features_pipeline() -> RideFeatures:
    return RideFeatures(spec=RideSpec(travel_time=None), cutoff=B.TRAIN_CUTOFF, rare=B.RARE_ORIGINS)


@query("ride_features", RIDE_FEATURES_SQL, covers=("UDF-6", "AG-1", "NUL-1", "FLT-1", "STR-3", "DT-3", "DT-4",
                                                   "DT-5", "DT-11", "ENC-1", "ENC-2", "PRJ-7"))
def q_ride_features(spark: SparkSession, d: str) -> DataFrame:
    rf = ride_features_pipeline()
    tickets = B.tickets(spark, d)
    rides = rf.count_tickets(tickets)
    return rf.fit_tickets(tickets).transform(rides, train=True).select("ride_id", "travel_date", "travel_from", "car_type",
                                          "number_of_tickets", "month", "week", "is_weekend")


# --------------------------------------------------------------------------
# counts, projections, filters
# --------------------------------------------------------------------------

@query("ride_counts", """
SELECT l_orderkey AS ride_id, CAST(l_shipdate AS DATE) AS travel_date, l_returnflag AS travel_from,
       l_linestatus AS car_type, count(*) AS number_of_tickets
FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_orderkey, l_shipdate, l_returnflag, l_linestatus
""", covers=("AG-1", "PRJ-4", "NUL-1"))
def q_ride_counts(spark, d):
    c = ride_counts(B.tickets(spark, d), ["ride_id", "travel_date", "travel_from", "car_type"])
    return c.withColumn("travel_date", F.to_date("travel_date"))


@query("ride_counts_cap", """
SELECT l_orderkey AS ride_id, CAST(l_shipdate AS DATE) AS travel_date, l_returnflag AS travel_from,
       l_linestatus AS car_type, CAST(l_linenumber AS INTEGER) AS max_capacity, count(*) AS counts
FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
  AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_shipdate, l_returnflag, l_linestatus, l_linenumber
""", covers=("AG-2", "PRJ-4"))
def q_ride_counts_cap(spark, d):
    c = ride_counts(B.tickets(spark, d, with_capacity=True),
                    ["ride_id", "travel_date", "travel_from", "car_type", "max_capacity"], name="counts")
    return c.withColumn("travel_date", F.to_date("travel_date"))


@query("ride_counts_having", """
SELECT CAST(l_shipdate AS DATE) AS travel_date, l_returnflag AS travel_from, l_linestatus AS car_type,
       count(*) AS counts
FROM lineitem
WHERE l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_shipdate, l_returnflag, l_linestatus
HAVING count(*) < 15
""", covers=("FLT-4",))
def q_ride_counts_having(spark, d):
    c = ride_counts(B.tickets(spark, d), ["travel_date", "travel_from", "car_type"], name="counts")
    return counts_below(c, "counts", 15).withColumn("travel_date", F.to_date("travel_date"))


@query("drop_select", """
SELECT o_orderkey AS ride_id, CAST(o_orderdate AS DATE) AS travel_date, o_orderpriority AS travel_from
FROM orders
""", covers=("PRJ-1", "PRJ-2", "PRJ-3"))
def q_drop_select(spark, d):
    o = load(spark, d, "orders")
    picked = o.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")       # ordered list
    named = picked.toDF("ride_id", "travel_date", "fare", "travel_from")                    # positional rename
    return named.drop("fare").withColumn("travel_date", F.to_date("travel_date"))


@query("date_cutoff", f"""
SELECT o_orderkey AS ride_id, CAST(o_orderdate AS DATE) AS travel_date
FROM orders WHERE o_orderdate >= TIMESTAMP '{B.TRAIN_CUTOFF}'
""", covers=("FLT-1",))
def q_date_cutoff(spark, d):
    rf = RideFeatures(spec=RideSpec(travel_date="travel_date"), cutoff=B.TRAIN_CUTOFF)
    r = rf._cutoff_filter(B.rides(spark, d))
    return r.select("ride_id", F.to_date("travel_date").alias("travel_date"))


@query("weekend_flag", """
SELECT o_orderkey AS ride_id, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN isodow(o_orderdate) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
FROM orders
""", covers=("DT-11", "PRJ-6"))
def q_weekend_flag(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"),
                                        weekday("o_orderdate").alias("day_of_week"))
    return o.withColumn("is_weekend", weekend_flag("day_of_week"))


@query("binary_flag", """
SELECT o_orderkey AS ride_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS car_type_is_f
FROM orders
""", covers=("PRJ-6",))
def q_binary_flag(spark, d):
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("ride_id"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("car_type_is_f"))


@query("calendar_features", """
SELECT o_orderkey AS ride_id, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS travel_date
FROM orders
""", covers=("DT-3", "DT-4", "DT-5", "DT-6", "DT-7", "PRJ-7"))
def q_calendar_features(spark, d):
    r = B.rides(spark, d).select("ride_id", F.to_date("travel_date").alias("travel_date"))
    r = r.withColumn("month", F.month("travel_date").cast("int")).withColumn("week", iso_week("travel_date")) \
         .withColumn("year", F.year("travel_date").cast("int")) \
         .withColumn("day", F.dayofmonth("travel_date").cast("int"))
    return r.withColumn("travel_date", weekday("travel_date"))       # overwrite last


@query("parse_dates", """
WITH s AS (
  SELECT o_orderkey AS ride_id,
         CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-d-%-m-%y')
              ELSE strftime(o_orderdate, '%Y-%-m-%-d') END AS travel_date_text
  FROM orders)
SELECT ride_id, travel_date_text,
       CAST(COALESCE(try_strptime(travel_date_text, '%d-%m-%y'), strptime(travel_date_text, '%Y-%m-%d')) AS DATE)
         AS travel_date
FROM s
""", covers=("DT-1", "DT-2"))
def q_parse_dates(spark, d):
    o = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d-M-yy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    s = o.select(F.col("o_orderkey").alias("ride_id"), text.alias("travel_date_text"))
    return s.withColumn("travel_date", parse_date("travel_date_text"))


# --------------------------------------------------------------------------
# clock strings (events.ts as "H:mm")
# --------------------------------------------------------------------------

_CLOCK = "strftime(ts, '%-H:%M')"


@query("clock_features", f"""
SELECT event_id AS ride_id, {_CLOCK} AS travel_time,
       CAST(split_part({_CLOCK}, ':', 1) AS INTEGER) AS hour_booked,
       CAST(split_part({_CLOCK}, ':', 2) AS INTEGER) AS minute_booked
FROM events
""", covers=("DT-8",))
def q_clock_features(spark, d):
    r = B.clock_rides(spark, d).drop("ts")
    return r.withColumn("hour_booked", clock_hour("travel_time")).withColumn("minute_booked", clock_minute("travel_time"))


@query("time_to_minutes", f"""
SELECT event_id AS ride_id,
       CAST(CAST(split_part({_CLOCK}, ':', 1) AS INTEGER) * 60 + CAST(split_part({_CLOCK}, ':', 2) AS INTEGER)
            AS INTEGER) AS travel_time
FROM events
""", covers=("STR-1", "UDF-1"))
def q_time_to_minutes(spark, d):
    r = B.clock_rides(spark, d)
    return r.select("ride_id", time_to_minutes("travel_time").alias("travel_time"))


@query("time_split", f"""
SELECT event_id AS ride_id, CAST(split_part({_CLOCK}, ':', 1) AS INTEGER) AS hour,
       CAST(split_part({_CLOCK}, ':', 2) AS INTEGER) AS minutes
FROM events
""", covers=("STR-2", "PRJ-8", "UDF-2"))
def q_time_split(spark, d):
    r = B.clock_rides(spark, d)
    parts = F.split("travel_time", ":", 2)                    # one split, two columns
    return r.select("ride_id", parts.getItem(0).cast("int").alias("hour"),
                    parts.getItem(1).cast("int").alias("minutes"))


@query("day_part", f"""
WITH m AS (
  SELECT event_id AS ride_id,
         CAST(split_part({_CLOCK}, ':', 1) AS INTEGER) * 60 + CAST(split_part({_CLOCK}, ':', 2) AS INTEGER) AS minutes
  FROM events)
SELECT ride_id, CAST(minutes AS INTEGER) AS minutes,
       CAST(CASE WHEN minutes / 60.0 >= 7 AND minutes / 60.0 < 10 THEN 1
                 WHEN minutes / 60.0 >= 10 AND minutes / 60.0 < 14 THEN 2
                 WHEN minutes / 60.0 >= 14 AND minutes / 60.0 < 19 THEN 3
                 WHEN minutes / 60.0 >= 19 AND minutes / 60.0 <= 24 THEN 4
                 WHEN minutes / 60.0 >= 1 AND minutes / 60.0 < 7 THEN 5
                 ELSE 6 END AS INTEGER) AS day_part
FROM m
""", covers=("DT-12",))
def q_day_part(spark, d):
    r = B.clock_rides(spark, d).select("ride_id", time_to_minutes("travel_time").alias("minutes"))
    return r.withColumn("day_part", day_part("minutes"))


# --------------------------------------------------------------------------
# strings, rounding, clipping, labels
# --------------------------------------------------------------------------

@query("rare_to_other", """
SELECT o_orderkey AS ride_id,
       CASE WHEN o_orderstatus IN ('4-NOT SPECIFIED', '5-LOW') THEN 'other' ELSE o_orderstatus END AS car_type,
       CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'other' ELSE o_orderpriority END AS travel_from
FROM orders
""", covers=("STR-3",))
def q_rare_to_other(spark, d):
    r = B.rides(spark, d).select("ride_id", "car_type", "travel_from")
    return rare_to_other(r, list(B.RARE_PRIORITIES))           # every string column


@query("round_half_even", """
SELECT l_orderkey AS ride_id, CAST(l_linenumber AS INTEGER) AS line, l_quantity / 2 AS p,
       CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS p_rounded
FROM lineitem
""", covers=("MTH-1",))
def q_round_half_even(spark, d):
    li = load(spark, d, "lineitem")
    p = F.col("l_quantity") / 2
    return li.select(F.col("l_orderkey").alias("ride_id"), F.col("l_linenumber").cast("int").alias("line"),
                     p.alias("p"), half_even(p).cast("double").alias("p_rounded"))


@query("clip_floor", """
WITH p AS (SELECT o_orderkey AS ride_id, o_totalprice / 50000.0 - 1.0 AS p FROM orders)
SELECT ride_id, round(p, 6) AS p,
       round(CASE WHEN p < 2 THEN 1.0 ELSE p END, 6) AS p_floor,
       round(greatest(p, 0.0), 6) AS p_clip
FROM p
""", covers=("FLT-5",))
def q_clip_floor(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"),
                                        (F.col("o_totalprice") / 50000.0 - 1.0).alias("p"))
    return o.select("ride_id", r6(F.col("p")).alias("p"), r6(floor_rule("p")).alias("p_floor"),
                    r6(F.greatest(F.col("p"), F.lit(0.0))).alias("p_clip"))


@query("threshold_label", """
SELECT l_orderkey AS ride_id, CAST(l_linenumber AS INTEGER) AS line,
       CAST(CASE WHEN l_quantity < 12 THEN 1 ELSE 0 END AS INTEGER) AS y_class
FROM lineitem
""", covers=("UDF-4",))
def q_threshold_label(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("ride_id"), F.col("l_linenumber").cast("int").alias("line"),
                     threshold_label("l_quantity", 12).alias("y_class"))


# --------------------------------------------------------------------------
# sort / top-k
# --------------------------------------------------------------------------

@query("sort_desc", """
SELECT o_orderkey AS ride_id, CAST(o_orderdate AS DATE) AS travel_date FROM orders
ORDER BY travel_date DESC, ride_id
""", covers=("ST-1",))
def q_sort_desc(spark, d):
    r = B.rides(spark, d).select("ride_id", F.to_date("travel_date").alias("travel_date"))
    return r.orderBy(F.desc("travel_date"), "ride_id")


@query("top_k", """
SELECT o_orderkey AS ride_id, o_totalprice AS fare FROM orders ORDER BY fare DESC, ride_id LIMIT 5
""", covers=("ST-4", "SNK-2"))
def q_top_k(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"), F.col("o_totalprice").alias("fare"))
    return o.orderBy(F.desc("fare"), "ride_id").limit(5)      # TakeOrderedAndProject: per-task top 5, then merge


# --------------------------------------------------------------------------
# encoders
# --------------------------------------------------------------------------

@query("category_codes", """
SELECT 'p_brand' AS column_name, v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL)
UNION ALL
SELECT 'p_type', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER)
FROM (SELECT DISTINCT p_type AS v FROM part WHERE p_type IS NOT NULL)
""", covers=("ENC-1", "AG-5"))
def q_category_codes(spark, d):
    p = load(spark, d, "part").select("p_brand", "p_type")
    codes = CategoryCodes(["p_brand", "p_type"]).fit(p)
    return codes.frame(spark, "p_brand").select(F.lit("p_brand").alias("column_name"), "value", "code").unionByName(
        codes.frame(spark, "p_type").select(F.lit("p_type").alias("column_name"), "value", "code"))


@query("category_codes_apply", """
WITH dict AS (
  SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT n_name AS v FROM nation WHERE n_regionkey = 0 AND n_name IS NOT NULL))
SELECT c.c_custkey, n.n_name, CAST(COALESCE(dict.code, -1) AS INTEGER) AS nation_code
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN dict ON n.n_name = dict.v
""", covers=("ENC-2",))
def q_category_codes_apply(spark, d):
    nation = load(spark, d, "nation")
    codes = CategoryCodes(["n_name"]).fit(nation.where(F.col("n_regionkey") == 0))
    cust = load(spark, d, "customer").select("c_custkey", "c_nationkey") \
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", "n_name")
    return codes.transform(cust, suffix="_code").withColumnRenamed("n_name_code", "nation_code")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("one_hot", "SELECT o_orderkey AS ride_id, o_orderstatus AS car_type, " + ", ".join(
    f"CAST(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS \"travel_from_{v}\""
    for v in _PRIORITIES) + " FROM orders", covers=("ENC-3", "PRJ-11"))
def q_one_hot(spark, d):
    r = B.rides(spark, d).select("ride_id", "car_type", "travel_from")
    return one_hot(r, "travel_from")


def _nation_dummies_sql(regions: tuple) -> str:
    return ("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
            f"WHERE n.n_regionkey IN ({', '.join(map(str, regions))})")


_TRAIN_NATIONS = sorted(f"NATION_{k}" for k in range(25) if k % 5 in (0, 1))


@query("align_columns", "SELECT t.c_custkey, " + ", ".join(
    f"CAST(CASE WHEN t.n_name = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS \"nation_{v}\"" for v in _TRAIN_NATIONS)
    + f" FROM ({_nation_dummies_sql((0, 1, 2, 3, 4))}) t", covers=("PRJ-10",))
def q_align_columns(spark, d):
    nation = load(spark, d, "nation")
    cust = load(spark, d, "customer").select("c_custkey", "c_nationkey") \
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    train = one_hot(cust.where(F.col("n_regionkey").isin(0, 1)).drop("n_regionkey"), "n_name", prefix="nation")
    test = one_hot(cust.drop("n_regionkey"), "n_name", prefix="nation")
    return align_columns(test, train.columns)


@query("encode_all_strings", """
WITH pn AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_name IS NOT NULL)),
     pb AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL)),
     pt AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT p_type AS v FROM part WHERE p_type IS NOT NULL))
SELECT p.p_partkey, CAST(COALESCE(pn.code, -1) AS INTEGER) AS p_name, CAST(COALESCE(pb.code, -1) AS INTEGER) AS p_brand,
       CAST(COALESCE(pt.code, -1) AS INTEGER) AS p_type, p.p_size, p.p_retailprice
FROM part p LEFT JOIN pn ON p.p_name = pn.v LEFT JOIN pb ON p.p_brand = pb.v LEFT JOIN pt ON p.p_type = pt.v
""", covers=("ENC-4", "PRJ-12"))
def q_encode_all_strings(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return encode_all_strings(p)


@query("auto_features", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_totalprice FROM orders)
SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice,
       CAST(day(o_orderdate) AS INTEGER) AS "DAY(o_orderdate)", CAST(year(o_orderdate) AS INTEGER) AS "YEAR(o_orderdate)",
       CAST(month(o_orderdate) AS INTEGER) AS "MONTH(o_orderdate)",
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS "WEEKDAY(o_orderdate)",
       CAST(length(o_orderpriority) AS INTEGER) AS "NUM_CHARACTERS(o_orderpriority)",
       CAST(CASE WHEN trim(o_orderpriority) = '' THEN 0
                 ELSE len(regexp_split_to_array(trim(o_orderpriority), '\\s+')) END AS INTEGER)
         AS "NUM_WORDS(o_orderpriority)",
       row_number() OVER (ORDER BY o_orderkey) - 1 AS train_index
FROM o
""", covers=("ENC-5", "ENC-6"))
def q_auto_features(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"),
                                        "o_orderpriority", "o_totalprice")
    return auto_features(o, index="train_index", order=["o_orderkey"])


# --------------------------------------------------------------------------
# travel-time tables: files, unions, shifts, scaling, joins
# --------------------------------------------------------------------------

def _daily_with_ids_sql() -> str:
    ids = "'100' AS origin_id, 'Central Station, Zone A' AS origin_name, '200' AS destination_id, " \
          "'Airport Road, Zone B' AS destination_name"
    measures = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MEASURE_COLUMNS)
    return f"SELECT date, {ids}, {measures} FROM ({DAILY_SQL})"


@query("multi_file_union", _daily_with_ids_sql(), covers=("SRC-3", "SRC-4", "UN-1", "PRJ-3"))
def q_multi_file_union(spark, d):
    """Write the daily table as one CSV folder per quarter, then read the list
    of folders back in one scan (MM/dd/yyyy dates, quoted names with commas)."""
    base = scratch_path(spark, "daily")
    write_daily_files(daily_travel_times(load(spark, d, "lineitem")), base)
    fs_paths = _list_dirs(spark, base)
    # measures are nullable (a day without lines of a band); reported as double
    return read_daily_files(spark, fs_paths).select(*ID_COLUMNS, *[F.col(c).cast("double") for c in MEASURE_COLUMNS])


def _list_dirs(spark: SparkSession, base: str) -> list[str]:
    """Quarter folders under ``base``, from the file listing of the written
    table (driver-side listing only, no scan; works on any shared file system)."""
    files = spark.read.option("header", True).csv(base).inputFiles()
    return sorted({f.rsplit("/", 1)[0] for f in files if "/quarter=" in f})


@query("csv_roundtrip", f"""
SELECT l_orderkey AS ride_id, CAST(count(*) AS DOUBLE) AS number_of_ticket
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey
""", covers=("SRC-1", "SNK-1"))
def q_csv_roundtrip(spark, d):
    counts = counts_per_key(load(spark, d, "lineitem"), "l_orderkey", "n")
    out = counts.select(F.col("l_orderkey").alias("ride_id"), F.col("n").cast("double").alias("number_of_ticket"))
    path = write_csv(out, scratch_path(spark, "submission"))
    return read_csv(spark, path, schema="ride_id long, number_of_ticket double")


@query("year_shift_union", SHIFTED_DAILY_SQL, covers=("UN-2", "FLT-2", "DT-9"))
def q_year_shift_union(spark, d):
    return _spark_shifted_daily(spark, d)


@query("minmax_scale", f"""
WITH u AS ({SHIFTED_DAILY_SQL}), s AS (SELECT min(city_travel_time) AS lo, max(city_travel_time) AS hi FROM u)
SELECT date, round(CASE WHEN hi = lo THEN 0.0 ELSE (city_travel_time - lo) * 1.0 / (hi - lo) END, 6)
         AS city_travel_time_scaled
FROM u, s
""", covers=("SCL-2", "AG-6"))
def q_minmax_scale(spark, d):
    s = minmax_scale(_spark_shifted_daily(spark, d, materialize=True), "city_travel_time", out="city_travel_time_scaled",
                     drop_source=True)
    return s.withColumn("city_travel_time_scaled", r6(F.col("city_travel_time_scaled")))


@query("standard_scale", f"""
WITH dl AS (SELECT date, daily_mean, daily_upper - daily_lower AS range FROM ({DAILY_SQL})),
s AS (SELECT avg(daily_mean) AS m1, stddev_pop(daily_mean) AS s1, avg(range) AS m2, stddev_pop(range) AS s2 FROM dl)
SELECT date, round((daily_mean - m1) / s1, 6) AS daily_mean, round((range - m2) / s2, 6) AS range
FROM dl, s
""", covers=("SCL-1", "AG-7", "PRJ-5"))
def q_standard_scale(spark, d):
    dl = daily_travel_times(load(spark, d, "lineitem")).select(
        "date", "daily_mean", (F.col("daily_upper") - F.col("daily_lower")).alias("range"))
    s = standard_scale(cut_lineage(dl), ["daily_mean", "range"])     # one row per day, read twice
    return s.select("date", r6(F.col("daily_mean")).alias("daily_mean"), r6(F.col("range")).alias("range"))


@query("day_of_month_mean", f"""
SELECT CAST(day(date) AS INTEGER) AS day, {', '.join(f'round(avg({c}), 6) AS {c}' for c in MEASURE_COLUMNS)}
FROM ({DAILY_SQL}) GROUP BY 1
""", covers=("AG-3", "UDF-5"))
def q_day_of_month_mean(spark, d):
    m = day_of_month_mean(daily_travel_times(load(spark, d, "lineitem")), "date")
    return m.select("day", *[r6(F.col(c)).alias(c) for c in MEASURE_COLUMNS])


_DOM_SQL = f"SELECT CAST(day(date) AS INTEGER) AS day, {', '.join(f'avg({c}) AS {c}' for c in MEASURE_COLUMNS)} " \
           f"FROM ({DAILY_SQL}) GROUP BY 1"


@query("left_join_day", f"""
WITH e AS (SELECT event_id AS ride_id, CAST(day(ts) AS INTEGER) AS day FROM events),
w AS ({_DOM_SQL})
SELECT e.ride_id, e.day, round(w.daily_mean, 6) AS daily_mean, round(w.daily_upper, 6) AS daily_upper
FROM e LEFT JOIN w ON e.day = w.day
""", covers=("JN-3",))
def q_left_join_day(spark, d):
    w = day_of_month_mean(daily_travel_times(load(spark, d, "lineitem")), "date")
    e = load(spark, d, "events").select(F.col("event_id").alias("ride_id"), F.dayofmonth("ts").cast("int").alias("day"))
    j = left_join_on(e, w, "day", bounded=True)                       # <= 31 rows
    return j.select("ride_id", "day", r6(F.col("daily_mean")).alias("daily_mean"),
                    r6(F.col("daily_upper")).alias("daily_upper"))


_HOUR_NAMES = {"AM": ("am_mean", "am_lower", "am_upper"), "Midday": ("midday_mean", "midday_lower", "midday_upper"),
               "PM": ("pm_mean", "pm_lower", "pm_upper"),
               "Evening": ("evening_mean", "evening_lower", "evening_upper"),
               "Early Morning": ("early_morning_mean", "early_morning_lower", "early_morning_upper")}


def _band_case(i: int) -> str:
    arms = [("hour >= 7 AND hour < 10", "am"), ("hour >= 10 AND hour < 14", "midday"),
            ("hour >= 14 AND hour < 19", "pm"), ("hour >= 19 AND hour < 24", "evening"),
            ("hour >= 0 AND hour < 7", "early_morning")]
    part = ("mean", "lower", "upper")[i]
    return "CASE " + " ".join(f"WHEN {c} THEN w.{k}_{part}" for c, k in arms) + " END"


@query("hour_band_pick", f"""
WITH e AS (SELECT event_id AS ride_id, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events),
w AS ({_DOM_SQL})
SELECT e.ride_id, e.day, e.hour, round({_band_case(0)}, 6) AS hour_mean_time,
       round({_band_case(1)}, 6) AS hour_min_time, round({_band_case(2)}, 6) AS hour_max_time
FROM e LEFT JOIN w ON e.day = w.day
""", covers=("DT-12", "UDF-3"))
def q_hour_band_pick(spark, d):
    w = day_of_month_mean(daily_travel_times(load(spark, d, "lineitem")), "date")
    e = load(spark, d, "events").select(F.col("event_id").alias("ride_id"), F.dayofmonth("ts").cast("int").alias("day"),
                                        F.hour("ts").cast("int").alias("hour"))
    j = hour_band_pick(left_join_on(e, w, "day", bounded=True), "hour", _HOUR_NAMES)
    return j.select("ride_id", "day", "hour", *[r6(F.col(c)).alias(c)
                                                for c in ("hour_mean_time", "hour_min_time", "hour_max_time")])


@query("left_join_mean_fill", f"""
WITH r AS (SELECT o_orderkey AS ride_id, CAST(o_orderdate AS DATE) AS travel_date FROM orders),
u AS ({SHIFTED_DAILY_SQL}),
j AS (SELECT r.ride_id, r.travel_date, u.city_travel_time FROM r LEFT JOIN u ON r.travel_date = u.date)
SELECT ride_id, travel_date, round(COALESCE(city_travel_time, (SELECT avg(city_travel_time) FROM j)), 6)
         AS city_travel_time
FROM j
""", covers=("JN-4", "NUL-2", "AG-4"))
def q_left_join_mean_fill(spark, d):
    r = B.rides(spark, d).select("ride_id", F.to_date("travel_date").alias("travel_date"))
    j = left_join_on(r, _spark_shifted_daily(spark, d), "travel_date", "date", bounded=True)   # one row per day
    f = fill_with_mean(j, "city_travel_time")
    return f.select("ride_id", "travel_date", r6(F.col("city_travel_time")).alias("city_travel_time"))


@query("band_year_shift", SHIFTED_BANDS_SQL, covers=("FLT-3", "UN-2", "DT-9", "DT-10"))
def q_band_year_shift(spark, d):
    """Weekday bands plus the copies whose start is after and end before the
    shift window (two chained filters on two date columns), one year ahead."""
    return _spark_weekday_bands(spark, d)


@query("weekday_name_index", f"""
SELECT dow AS day_of_week, q_start AS date_start, q_end AS date_end, mean_travel_day, lower_travel_day, upper_travel_day
FROM ({WEEKDAY_BANDS_SQL})
""", covers=("DT-10",))
def q_weekday_name_index(spark, d):
    wk = parse_date_range(weekday_travel_times(load(spark, d, "lineitem")))
    return wk.select(weekday_from_name("day_of_week_name").alias("day_of_week"), "date_start", "date_end",
                     "mean_travel_day", "lower_travel_day", "upper_travel_day")


_BAND_JOIN_SQL = f"""
WITH band AS ({SHIFTED_BANDS_SQL}),
calendar AS (
    SELECT CAST(t.day AS DATE) AS band_day, mean_travel_day, lower_travel_day, upper_travel_day
    FROM band, unnest(generate_series(band.date_start, band.date_end, INTERVAL 1 DAY)) AS t(day)
    WHERE isodow(t.day) - 1 = band.day_of_week),
ride AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS order_day FROM orders)
SELECT o_orderkey AS ride_id, order_day AS travel_date, o_orderpriority AS travel_from,
       CAST(isodow(order_day) - 1 AS INTEGER) AS day_of_week, CAST(isodow(order_day) >= 6 AS INTEGER) AS is_weekend,
       mean_travel_day, lower_travel_day, upper_travel_day
FROM ride JOIN calendar ON order_day = band_day
"""


def _train_rides(spark, d):
    r = B.rides(spark, d).select("ride_id", F.to_date("travel_date").alias("travel_date"), "travel_from")
    r = r.withColumn("day_of_week", weekday("travel_date"))
    return r.withColumn("is_weekend", weekend_flag("day_of_week"))


@query("sql_band_join", _BAND_JOIN_SQL, covers=("JN-1", "SRC-6"))
def q_sql_band_join(spark, d):
    """The band join as SQL text: bands become the calendar days they cover, joined to rides by date."""
    rides, bands = _train_rides(spark, d), _spark_weekday_bands(spark, d)
    days = spark.sql("""
        SELECT one_day AS band_day, mean_travel_day, lower_travel_day, upper_travel_day
        FROM {bands} LATERAL VIEW explode(sequence(date_start, date_end)) AS one_day
        WHERE date_start <= date_end AND weekday(one_day) = day_of_week""", bands=bands)
    days, small = bounded_broadcast(days)
    return spark.sql(f"""
        SELECT {"/*+ BROADCAST(c) */" if small else ""} r.ride_id, r.travel_date, r.travel_from, r.day_of_week,
               r.is_weekend, c.mean_travel_day, c.lower_travel_day, c.upper_travel_day
        FROM {{rides}} AS r JOIN {{days}} AS c ON r.travel_date = c.band_day""", rides=rides, days=days)


@query("df_band_join", _BAND_JOIN_SQL, covers=("JN-1",))
def q_df_band_join(spark, d):
    bands = _spark_weekday_bands(spark, d)
    return band_join(_train_rides(spark, d), bands, "travel_date", "day_of_week",
                     take=["mean_travel_day", "lower_travel_day", "upper_travel_day"])


# --------------------------------------------------------------------------
# splits and folds
# --------------------------------------------------------------------------

_MD5 = "md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '1'))"


@query("holdout_split", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1 AS rk,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey AS ride_id, CAST(CASE WHEN rk >= n - ceil(n * 0.3) THEN 1 ELSE 0 END AS INTEGER) AS is_test FROM r
""", covers=("SPL-1",))
def q_holdout_split(spark, d):
    r = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"))
    return holdout_split(r, "ride_id", test_size=0.3, seed=1, shuffle=True)


@query("holdout_ordered", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)
SELECT o_orderkey AS ride_id, CAST(CASE WHEN rk >= n - ceil(n * 0.25) THEN 1 ELSE 0 END AS INTEGER) AS is_test FROM r
""", covers=("SPL-2",))
def q_holdout_ordered(spark, d):
    r = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"))
    return holdout_split(r, "ride_id", test_size=0.25, shuffle=False)


@query("kfold_ntile", """
SELECT o_orderkey AS ride_id, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders
""", covers=("SPL-3",))
def q_kfold_ntile(spark, d):
    r = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"))
    return kfold_ntile(r, "ride_id", k=5)


@query("kfold_stratified", """
SELECT o_orderkey AS ride_id, o_orderpriority AS label,
       CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders
""", covers=("SPL-4",))
def q_kfold_stratified(spark, d):
    r = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"), F.col("o_orderpriority").alias("label"))
    return kfold_stratified(r, "ride_id", "label", k=5)


# --------------------------------------------------------------------------
# metrics and out-of-fold group means
# --------------------------------------------------------------------------

_GROUP_MEAN_SQL = """
WITH y AS (SELECT o_orderkey AS ride_id, o_orderpriority AS g, o_totalprice AS y FROM orders),
m AS (SELECT g, avg(y) AS p FROM y GROUP BY g)
SELECT y.ride_id, y.g, y.y, m.p FROM y JOIN m ON y.g = m.g
"""


def _group_mean_frame(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"), F.col("o_orderpriority").alias("g"),
                                        F.col("o_totalprice").alias("y"))
    means = o.groupBy("g").agg(F.avg("y").alias("p"))      # one row per group (partial aggregation)
    return o.join(means, "g")


@query("metrics", f"""
WITH f AS ({_GROUP_MEAN_SQL})
SELECT round(avg(abs(y - p)), 6) AS mae, round(avg(abs(y - round_even(p, 0))), 6) AS mae_rounded,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(sqrt(avg(abs(y - p))), 6) AS sqrt_mae,
       round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, count(*) AS n
FROM f
""", covers=("MET-1", "MET-2", "MET-3", "MET-4", "MET-5", "MTH-2"))
def q_metrics(spark, d):
    f = _group_mean_frame(spark, d)
    out = regression_metrics(f, "y", "p", with_rounded=True)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("mae", "mae_rounded", "rmse", "sqrt_mae",
                                                          "explained_variance", "r2")], "n")


# Out-of-fold group mean: the prediction for a row in fold i is the mean of y
# over rows of the same group outside fold i, from per-(group, fold) sums.
_OOF_SQL = """
WITH f AS (SELECT o_orderkey AS ride_id, o_orderpriority AS g, o_totalprice AS y,
                  CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders),
gf AS (SELECT g, fold, sum(y) AS s, count(*) AS c FROM f GROUP BY g, fold),
gt AS (SELECT g, sum(s) AS s, sum(c) AS c FROM gf GROUP BY g),
o AS (SELECT f.ride_id, f.fold, f.y,
             CASE WHEN gt.c - gf.c > 0 THEN (gt.s - gf.s) / (gt.c - gf.c) END AS oof_pred
      FROM f JOIN gf ON f.g = gf.g AND f.fold = gf.fold JOIN gt ON f.g = gt.g)
"""


def _oof_frame(spark, d):
    from ridecast.models.ensemble import oof_group_mean
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"), F.col("o_orderpriority").alias("g"),
                                        F.col("o_totalprice").alias("y"))
    f = kfold_ntile(o, "ride_id", k=5)
    return oof_group_mean(f, "g", "y", "fold", out="oof_pred")


@query("oof_stack", _OOF_SQL + "SELECT ride_id, fold, round(oof_pred, 6) AS oof_pred FROM o",
       covers=("ENS-2", "PRJ-11"))
def q_oof_stack(spark, d):
    return _oof_frame(spark, d).select("ride_id", "fold", r6(F.col("oof_pred")).alias("oof_pred"))


@query("cv_mean_score", _OOF_SQL + """
SELECT round(avg(fold_mae), 6) AS cv_mae, count(*) AS folds
FROM (SELECT fold, avg(abs(y - oof_pred)) AS fold_mae FROM o GROUP BY fold)
""", covers=("AG-9", "SEL-4"))
def q_cv_mean_score(spark, d):
    from ridecast.operators.metrics import cv_mean_score
    s = cv_mean_score(_oof_frame(spark, d), "y", "oof_pred", "fold")
    return s.select(r6(F.col("cv_mae")).alias("cv_mae"), "folds")


_CLASS_SQL = """
WITH y AS (SELECT l_orderkey AS ride_id, CAST(l_linenumber AS INTEGER) AS line, l_returnflag AS g,
                  CASE WHEN l_quantity < 12 THEN 1 ELSE 0 END AS y FROM lineitem),
m AS (SELECT g, avg(y) AS p1 FROM y GROUP BY g),
f AS (SELECT y.ride_id, y.line, y.y, CASE WHEN m.p1 >= 0.5 THEN 1 ELSE 0 END AS p,
             CASE WHEN y.y = 1 THEN m.p1 ELSE 1 - m.p1 END AS p_true FROM y JOIN m ON y.g = m.g)
"""


def _class_frame(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride_id"),
                                           F.col("l_linenumber").cast("int").alias("line"),
                                           F.col("l_returnflag").alias("g"),
                                           threshold_label("l_quantity", 12).alias("y"))
    m = li.groupBy("g").agg(F.avg("y").alias("p1"))
    f = li.join(m, "g")
    return f.select("ride_id", "line", "y", F.when(F.col("p1") >= 0.5, 1).otherwise(0).alias("p"),
                    F.when(F.col("y") == 1, F.col("p1")).otherwise(1 - F.col("p1")).alias("p_true"))


@query("class_metrics", _CLASS_SQL + """
SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n,
       round(-avg(ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) AS log_loss
FROM f
""", covers=("MET-6",))
def q_class_metrics(spark, d):
    from ridecast.operators.metrics import class_metrics
    m = class_metrics(_class_frame(spark, d), "y", "p", prob="p_true")
    return m.select(r6(F.col("accuracy")).alias("accuracy"), "n", r6(F.col("log_loss")).alias("log_loss"))


@query("confusion_counts", _CLASS_SQL + """
SELECT y AS actual, p AS predicted, count(*) AS n FROM f GROUP BY y, p
""", covers=("MET-6",))
def q_confusion_counts(spark, d):
    from ridecast.operators.metrics import confusion_counts
    f = _class_frame(spark, d)
    return confusion_counts(f, "y", "p").select(F.col("actual").cast("int"), F.col("predicted").cast("int"), "n")


@query("onehot_features", """
WITH c AS (
  SELECT l_orderkey AS ride_id, l_shipdate AS travel_date, l_returnflag AS travel_from, l_linestatus AS car_type,
         CAST(l_linenumber AS INTEGER) AS max_capacity, count(*) AS counts
  FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
    AND l_linenumber IS NOT NULL
  GROUP BY l_orderkey, l_shipdate, l_returnflag, l_linestatus, l_linenumber
  HAVING count(*) < 15),
m AS (SELECT ride_id, max_capacity, counts, CAST(day(travel_date) AS INTEGER) AS day,
             CASE WHEN travel_from IN ('R') THEN 'other' ELSE travel_from END AS tf,
             CASE WHEN car_type IN ('R') THEN 'other' ELSE car_type END AS car_type FROM c)
SELECT ride_id, max_capacity, counts, day, CAST(CASE WHEN car_type = 'F' THEN 1 ELSE 0 END AS INTEGER) AS car_type_is_bus,
       CAST(CASE WHEN tf = 'A' THEN 1 ELSE 0 END AS INTEGER) AS travel_from_A,
       CAST(CASE WHEN tf = 'N' THEN 1 ELSE 0 END AS INTEGER) AS travel_from_N,
       CAST(CASE WHEN tf = 'other' THEN 1 ELSE 0 END AS INTEGER) AS travel_from_other
FROM m
""", covers=("UDF-5", "AG-2", "FLT-4", "DT-7", "STR-3", "ENC-3", "PRJ-6"))
def q_onehot_features(spark, d):
    """Counts per ride with capacity as a key, rides under 15 tickets, then
    the one-hot feature table (day of month, merged origins, bus flag, one
    column per origin)."""
    from ridecast.plans.flows import onehot_features
    c = ride_counts(B.tickets(spark, d, with_capacity=True),
                    ["ride_id", "travel_date", "travel_from", "car_type", "max_capacity"], name="counts")
    return onehot_features(counts_below(c, "counts", 15), time_col=None, rare=B.RARE_ORIGINS, bus_value="F")


@query("band_features", f"""
WITH j AS ({_BAND_JOIN_SQL}),
tf AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT travel_from AS v FROM j WHERE travel_from IS NOT NULL)),
x AS (SELECT j.ride_id, j.day_of_week, j.is_weekend, CAST(COALESCE(tf.code, -1) AS INTEGER) AS travel_from,
             j.mean_travel_day, j.upper_travel_day - j.lower_travel_day AS range
      FROM j LEFT JOIN tf ON j.travel_from = tf.v),
s AS (SELECT avg(mean_travel_day) AS m1, stddev_pop(mean_travel_day) AS s1, avg(range) AS m2,
             stddev_pop(range) AS s2 FROM x)
SELECT ride_id, day_of_week, is_weekend, travel_from, round((mean_travel_day - m1) / s1, 6) AS mean_travel_day,
       round((range - m2) / s2, 6) AS range
FROM x, s
""", covers=("JN-1", "ENC-1", "ENC-2", "PRJ-5", "SCL-1", "AG-7"))
def q_band_features(spark, d):
    """The SQL-enrichment flow end to end: rides band-joined to the weekday
    travel-time bands, origin coded (dictionary fitted on the joined rides),
    range = upper - lower, then mean and range standardized with the
    population std over the joined rides."""
    j = band_join(_train_rides(spark, d), _spark_weekday_bands(spark, d), "travel_date", "day_of_week",
                  take=["mean_travel_day", "lower_travel_day", "upper_travel_day"])
    j = CategoryCodes(["travel_from"]).fit_transform(j)
    j = j.withColumn("range", F.col("upper_travel_day") - F.col("lower_travel_day"))
    s = standard_scale(j, ["mean_travel_day", "range"])
    return s.select("ride_id", "day_of_week", "is_weekend", "travel_from",
                    r6(F.col("mean_travel_day")).alias("mean_travel_day"), r6(F.col("range")).alias("range"))
