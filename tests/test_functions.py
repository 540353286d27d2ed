import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridecast.functions.calendar import (
    add_years, day_part, hour_band, iso_week, parse_date, weekday, weekday_from_name, weekend_flag,
)
from ridecast.functions.clock import clock_hour, clock_minute, time_to_minutes
from ridecast.functions.mathx import floor_rule, half_even, threshold_label


def test_parse_date_both_formats_and_pivot(spark):
    df = spark.createDataFrame([("7-4-17",), ("2017-4-6",), ("31-12-99",), ("1-1-68",), ("1-1-69",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_date("s")).collect()]
    assert got == [dt.date(2017, 4, 7), dt.date(2017, 4, 6), dt.date(1999, 12, 31), dt.date(2068, 1, 1),
                   dt.date(1969, 1, 1), None]


def test_parse_date_strict_raises(spark):
    df = spark.createDataFrame([("not a date",)], "s string")
    with pytest.raises(Exception):
        df.select(parse_date("s")).collect()


def test_weekday_week_weekend(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 1),), (dt.date(2017, 1, 2),), (dt.date(2017, 1, 7),)], "d date")
    rows = df.select(weekday("d").alias("w"), iso_week("d").alias("k")).withColumn("we", weekend_flag("w")).collect()
    assert [(r.w, r.k, r.we) for r in rows] == [(6, 52, 1), (0, 1, 0), (5, 1, 1)]


def test_leap_day_shift(spark):
    df = spark.createDataFrame([(dt.date(2016, 2, 29),)], "d date")
    assert df.select(add_years("d")).first()[0] == dt.date(2017, 2, 28)


def test_half_even_and_floor_rule(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (1.5,), (2.0,)], "p double")
    rows = df.select(half_even("p").alias("r"), floor_rule("p").alias("f"),
                     threshold_label("p", 2).alias("t")).collect()
    assert [r.r for r in rows] == [2.0, 4.0, -0.0, 2.0, 2.0]
    assert [r.f for r in rows] == [2.5, 3.5, 1.0, 1.0, 2.0]     # under 2 -> 1, not 2
    assert [r.t for r in rows] == [0, 0, 1, 1, 0]


def test_clock_and_bands(spark):
    df = spark.createDataFrame([("0:05",), ("7:00",), ("9:59",), ("10:00",), ("14:00",), ("19:00",), ("23:59",)],
                               "t string")
    rows = df.select(clock_hour("t").alias("h"), clock_minute("t").alias("m"), time_to_minutes("t").alias("mins"),
                     hour_band(clock_hour("t")).alias("band"), day_part(time_to_minutes("t")).alias("dp")).collect()
    assert [r.mins for r in rows] == [5, 420, 599, 600, 840, 1140, 1439]
    assert [r.band for r in rows] == ["Early Morning", "AM", "AM", "Midday", "PM", "Evening", "Evening"]
    assert [r.dp for r in rows] == [6, 1, 1, 2, 3, 4, 4]


def test_weekday_from_name(spark):
    df = spark.createDataFrame([("Monday",), ("Sunday",), ("Funday",)], "n string")
    assert [r[0] for r in df.select(weekday_from_name("n")).collect()] == [0, 6, None]


def test_parse_date_matches_strptime_randomized(spark):
    """Random dates 1969..2068 written in both formats parse back exactly as
    Python's strptime reads them (two-digit years pivot at 69)."""
    import random
    rng = random.Random(7)
    days = [dt.date(1969, 1, 1) + dt.timedelta(days=rng.randrange(0, 36500)) for _ in range(400)]
    texts = [d.strftime("%-d-%-m-%y") if i % 2 else d.strftime("%Y-%-m-%-d") for i, d in enumerate(days)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", parse_date("s").alias("d")).collect()}
    for i, t in enumerate(texts):
        fmt = "%d-%m-%y" if i % 2 else "%Y-%m-%d"
        assert got[i] == dt.datetime.strptime(t, fmt).date(), t
