"""Queries that run a pair on both of its sides, or a source in the form that its users meet it: inferred CSV, registered
tables, rides with several tickets, scoring rides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridecast.models.subset import forward_selection
from ridecast.operators.aggregate import ride_counts
from ridecast.operators.encode import SparseOneHot
from ridecast.operators.enrich import band_join
from ridecast.operators.frames import counts_in_frame
from ridecast.plans import bindings as B
from ridecast.plans.registry import query
from ridecast.plans.relational import _BAND_JOIN_SQL, _spark_weekday_bands, _train_rides
from ridecast.plans.rides import RideFeatures, RideSpec
from ridecast.session import cut_lineage, scratch_path
from ridecast.sources.csv_io import read_csv, write_csv
from ridecast.sources.tables import load

SHARED = """
    tickets AS (
        SELECT floor(l_suppkey / 4)::BIGINT AS ride_id, date_trunc('quarter', l_shipdate)::DATE AS travel_date,
            (l_linenumber % 2 * 7 + 6) || ':05' AS travel_time, l_returnflag AS travel_from, l_linestatus AS car_type,
            CASE WHEN l_quantity >= 25 THEN 49 ELSE 11 END AS max_capacity
        FROM lineitem)"""
KEYS = ["ride_id", "travel_date", "travel_time", "travel_from", "car_type"]


def _counts_sql(keys: list[str]) -> str:
    return f"""WITH {SHARED}
SELECT {', '.join(keys)}, count(*) AS number_of_tickets FROM tickets
WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY ALL"""


@query("shared_ride_counts", _counts_sql(KEYS), covers=("AG-1", "PRJ-4", "NUL-1"))
def q_shared_ride_counts(spark, d):
    """Tickets per ride of five keys, the clock among them; a ride has about seven."""
    return ride_counts(B.shared_tickets(spark, d), KEYS, "number_of_tickets")


@query("shared_ride_counts_cap", _counts_sql([*KEYS, "max_capacity"]), covers=("AG-2",))
def q_shared_ride_counts_cap(spark, d):
    """The same with the capacity as a sixth key."""
    return ride_counts(B.shared_tickets(spark, d), [*KEYS, "max_capacity"], "number_of_tickets")


def _features_sql(train: bool) -> str:
    """The fitted dictionaries come from rides before the scoring date, whichever side is transformed."""
    side = "<" if train else ">="
    label = ", number_of_tickets" if train else ""
    return f"""WITH {SHARED},
    rides AS ({_counts_sql(KEYS).split(SHARED, 1)[1]}),
    merged AS (
        SELECT * REPLACE (CASE WHEN travel_from = 'R' THEN 'other' ELSE travel_from END AS travel_from) FROM rides),
    fitted AS (SELECT * FROM merged WHERE travel_date < DATE '{B.SCORE_FROM}' AND car_type <> 'F'),
    froms AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT travel_from AS v FROM fitted)),
    cars AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT car_type AS v FROM fitted))
SELECT ride_id, (isodow(travel_date) - 1)::INT AS travel_date, coalesce(froms.code, -1)::INT AS travel_from,
    coalesce(cars.code, -1)::INT AS car_type{label}, month(travel_date)::INT AS month, weekofyear(travel_date)::INT AS week,
    split_part(travel_time, ':', 1)::INT AS hour_booked, split_part(travel_time, ':', 2)::INT AS minute_booked,
    CASE WHEN isodow(travel_date) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM merged LEFT JOIN froms ON travel_from = froms.v LEFT JOIN cars ON car_type = cars.v
WHERE merged.travel_date {side} DATE '{B.SCORE_FROM}'{" AND car_type <> 'F'" if train else ""}"""


def _clock_rides(spark, d):
    """A pipeline fitted on the rides before the scoring date (of all but one car type), and both sides."""
    rides = ride_counts(B.shared_tickets(spark, d), KEYS, "number_of_tickets")
    before = F.col("travel_date") < F.lit(B.SCORE_FROM).cast("date")
    train = rides.where(before & (F.col("car_type") != "F"))
    pair = RideFeatures(spec=RideSpec(), rare=("R",))
    return pair.fit(train), train, rides.where(~before).drop("number_of_tickets")


@query("clock_features_train", _features_sql(True), covers=("UDF-6", "DT-8", "UDF-1"))
def q_clock_features_train(spark, d):
    """Calendar, clock and category features of the training side."""
    pair, train, _ = _clock_rides(spark, d)
    return pair.transform(train, train=True)


@query("clock_features_score", _features_sql(False), covers=("UDF-6", "DT-8", "ENC-2"))
def q_clock_features_score(spark, d):
    """The same pair on the rides to score; a car type that training has not seen is -1."""
    pair, _, score = _clock_rides(spark, d)
    return pair.transform(score)


@query("score_band_join", f"SELECT * FROM ({_BAND_JOIN_SQL}) WHERE travel_date >= DATE '{B.SCORE_FROM}'", covers=("JN-2",))
def q_score_band_join(spark, d):
    """The band join of the rides to score."""
    rides = _train_rides(spark, d).where(F.col("travel_date") >= F.lit(B.SCORE_FROM).cast("date"))
    return band_join(rides, _spark_weekday_bands(spark, d), "travel_date", "day_of_week",
                     take=["mean_travel_day", "lower_travel_day", "upper_travel_day"])


@query("registered_band_join", _BAND_JOIN_SQL, covers=("SRC-5", "SRC-6", "JN-1"))
def q_registered_band_join(spark, d):
    """Tables registered by name, then joined by SQL text over these names."""
    cut_lineage(_train_rides(spark, d)).createOrReplaceTempView("train_rides")
    _spark_weekday_bands(spark, d).createOrReplaceTempView("weekday_bands")
    spark.sql("""
        SELECT one_day, mean_travel_day, lower_travel_day, upper_travel_day
        FROM weekday_bands LATERAL VIEW explode(sequence(date_start, date_end)) AS one_day
        WHERE date_start <= date_end AND weekday(one_day) = day_of_week""").createOrReplaceTempView("band_days")
    return spark.sql("""
        SELECT ride_id, travel_date, travel_from, r.day_of_week, is_weekend, mean_travel_day, lower_travel_day, upper_travel_day
        FROM train_rides AS r JOIN band_days ON travel_date = one_day""")


@query("csv_inferred", """
SELECT o_orderkey AS ride_id, strftime(o_orderdate, '%Y-%m-%d') AS travel_date, o_orderpriority AS travel_from,
    o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS seats, 'long, date, string, double, long' AS kinds
FROM orders
""", covers=("SRC-2",))
def q_csv_inferred(spark, d):
    """A CSV file whose column types are inferred from all of its rows, not a sample; empty fields are null."""
    orders = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("ride_id"), F.to_date("o_orderdate").alias("travel_date"), F.col("o_orderpriority").alias("travel_from"),
        F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("seats"))
    read = read_csv(spark, write_csv(orders, scratch_path(spark, "inferred")), infer=True)
    kinds = ", ".join({"int": "long", "bigint": "long"}.get(t, t) for _, t in read.dtypes)
    return read.select(F.col("ride_id").cast("long").alias("ride_id"), F.col("travel_date").cast("string").alias("travel_date"),
                       "travel_from", "price", F.col("seats").cast("long").alias("seats"), F.lit(kinds).alias("kinds"))


@query("sparse_one_hot", f"""
WITH train AS (
        SELECT nullif(l_orderkey % 17000, 5) AS v, l_returnflag AS f FROM lineitem WHERE l_shipdate < TIMESTAMP '{B.SCORE_FROM}'),
    dict AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM train WHERE v IS NOT NULL)),
    flags AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT DISTINCT f FROM train WHERE f IS NOT NULL)),
    n AS (SELECT (SELECT count(*) FROM dict) AS a, (SELECT count(*) FROM flags) AS b)
SELECT l_orderkey, l_linenumber, CASE WHEN dict.code IS NULL THEN '(' || (a + b) || ',[' || (a + flags.code) || '],[1.0])'
    ELSE '(' || (a + b) || ',[' || dict.code || ',' || (a + flags.code) || '],[1.0,1.0])' END AS features
FROM lineitem LEFT JOIN dict ON dict.v = nullif(l_orderkey % 17000, 5) LEFT JOIN flags ON flags.f = l_returnflag, n
""", covers=("ENC-3", "PRJ-10", "PRJ-11"))
def q_sparse_one_hot(spark, d):
    """One-hot of thousands of values as sparse vectors of the training width, null and unseen values among them."""
    tickets = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.nullif(F.col("l_orderkey") % 17000, F.lit(5)).alias("v"),
        F.col("l_returnflag").alias("f"))
    hot = SparseOneHot(["v", "f"]).fit(tickets.where(F.col("l_shipdate") < F.lit(B.SCORE_FROM).cast("timestamp_ntz")))
    return hot.transform(tickets.drop("l_shipdate")).withColumn("features", F.col("features").cast("string"))


@query("trips_in_frame", """
SELECT l_orderkey, l_linenumber, l_returnflag AS travel_from, l_shipdate::DATE AS travel_date,
    count(*) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate::DATE RANGE BETWEEN INTERVAL 14 DAY PRECEDING
        AND INTERVAL 1 DAY PRECEDING) AS trips
FROM lineitem WHERE l_shipdate IS NOT NULL
""")
def q_trips_in_frame(spark, d):
    """Trips from the same origin in the two weeks before each ticket's day."""
    tickets = load(spark, d, "lineitem").where("l_shipdate is not null").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("travel_from"), F.to_date("l_shipdate").alias("travel_date"))
    return counts_in_frame(tickets, "travel_from", "travel_date", 14, "trips")


@query("feature_search", """
WITH r AS (
        SELECT o_totalprice AS y, o_orderkey % 3 AS fold, month(o_orderdate)::DOUBLE AS month, c.n::DOUBLE AS tickets
        FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) AS c ON l_orderkey = o_orderkey
        WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL),
    o AS (SELECT a.fold, r.y, r.month, r.tickets FROM (SELECT DISTINCT fold FROM r) AS a JOIN r ON a.fold <> r.fold),
    f AS (
        SELECT fold, avg(y) AS mean, regr_slope(y, month) AS b1, regr_intercept(y, month) AS a1,
            regr_slope(y, tickets) AS b2, regr_intercept(y, tickets) AS a2 FROM o GROUP BY fold),
    e AS (
        SELECT avg((y - mean) ^ 2) AS base, avg((y - a1 - b1 * month) ^ 2) AS by_month, avg((y - a2 - b2 * tickets) ^ 2) AS by_tickets
        FROM r JOIN f USING (fold))
SELECT 0 AS step, NULL AS feature, round(base / 1e6, 4) AS cv_mse FROM e
UNION ALL SELECT 1, CASE WHEN by_month <= by_tickets THEN 'month' ELSE 'tickets' END, round(least(by_month, by_tickets) / 1e6, 4)
FROM e WHERE least(by_month, by_tickets) < base
""")
def q_feature_search(spark, d):
    """The first feature that forward selection takes, if one beats the mean in cross-validation."""
    rides = B.labelled_rides(spark, d).join(
        load(spark, d, "orders").select(F.col("o_orderkey").alias("ride_id"), F.col("o_totalprice").alias("y")), "ride_id")
    rides = rides.select("y", (F.col("ride_id") % 3).alias("fold"), F.month("travel_date").alias("month"),
                         F.col("number_of_tickets").alias("tickets"))
    return forward_selection(rides, ["month", "tickets"], "y", "fold", most=1).withColumn("cv_mse", F.round(F.col("cv_mse") / 1e6, 4))
