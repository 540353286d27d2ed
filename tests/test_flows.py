"""End-to-end flows on small fixtures of the ticket / rides-to-score shape."""

import datetime as dt

from pyspark.sql import functions as F

from ridecast.plans.flows import daily_travel_times, enrich_rides, forecast
from ridecast.plans.rides import RideSpec
from ridecast.sources.travel import MEASURE_COLUMNS, daily_file_frame


def _tickets(spark):
    rows = []
    origins = ["Northgate", "Eastport", "Bayside", "Smallville"]
    for ride in range(60):
        day = dt.date(2017, 3, 25) + dt.timedelta(days=ride % 40)
        text = day.strftime("%-d-%-m-%y") if ride % 2 else day.strftime("%Y-%-m-%-d")
        n = 1 + (ride * 7) % 11
        for _ in range(n):
            rows.append((ride, text, f"{5 + ride % 15}:{(ride * 13) % 60:02d}", origins[ride % 4],
                         "Bus" if ride % 3 else "shuttle", 49 if ride % 3 else 11))
    rows.append((999, "1-4-17", None, "Northgate", "Bus", 49))                 # null key: dropped
    return spark.createDataFrame(rows, "ride_id long, travel_date string, travel_time string, "
                                       "travel_from string, car_type string, max_capacity int")


def _rides_to_score(spark):
    rows = [(1000 + i, f"{1 + i}-6-18", f"{6 + i}:30", o, c, "Capital", 49)
            for i, (o, c) in enumerate([("Northgate", "Bus"), ("Hilltop", "Bus"), ("Eastport", "van")])]
    return spark.createDataFrame(rows, "ride_id long, travel_date string, travel_time string, travel_from string, "
                                       "car_type string, travel_to string, max_capacity int")


def test_forecast_end_to_end(spark):
    t, s = _tickets(spark), _rides_to_score(spark)
    a = forecast(t, s, cutoff="2017-04-01", rare=("Smallville",), bags=2, n_estimators=5, max_depth=4)
    b = forecast(t, s, cutoff="2017-04-01", rare=("Smallville",), bags=2, n_estimators=5, max_depth=4)
    assert a.columns == ["ride_id", "number_of_ticket"]
    ra = sorted(map(tuple, a.collect()))
    assert ra == sorted(map(tuple, b.collect()))                          # fixed seeds -> same forecast
    assert [r[0] for r in ra] == [1000, 1001, 1002]
    assert all(float(r[1]).is_integer() and 1 <= r[1] <= 11 for r in ra)  # rounded, within the label range


def test_daily_travel_times_and_enrich(spark, tmpdir_fresh):
    days = [(dt.date(2017, 6, 28) + dt.timedelta(days=i),) for i in range(10)]
    df = spark.createDataFrame(days, "date date")
    for j, c in enumerate(MEASURE_COLUMNS):
        df = df.withColumn(c, (F.dayofmonth("date") * 10 + j).cast("int"))
    path = f"{tmpdir_fresh}/q"
    daily_file_frame(df).drop("quarter").coalesce(1).write.option("header", True).csv(path)
    tt = daily_travel_times(spark, [path], after="2017-06-30", before="2017-07-03")
    got = sorted((r.date, r.city_travel_time_scaled) for r in tt.collect())
    assert len(got) == 12 and (dt.date(2018, 7, 1), got[3][1]) in got     # 07-01 and 07-02 copied a year ahead
    rides = spark.createDataFrame([(1, dt.date(2017, 6, 29)), (2, dt.date(2016, 1, 1))], "ride_id long, travel_date date")
    e = {r.ride_id: r.city_travel_time_scaled for r in enrich_rides(rides, tt, fill=["city_travel_time_scaled"]).collect()}
    assert e[2] == e[1]                                                    # unmatched ride gets the mean of matched ones


def test_onehot_features_train_and_aligned_test(spark):
    from ridecast.operators.encode import align_columns
    from ridecast.plans.flows import onehot_features
    train = spark.createDataFrame([(1, "17-10-17", "7:15", "Northgate", "Bus", 3), (2, "2017-11-19", "8:05", "Tinytown", "shuttle", 2)],
                                  "ride_id long, travel_date string, travel_time string, travel_from string, "
                                  "car_type string, counts long")
    tr = onehot_features(train, rare=("Tinytown",))
    assert tr.columns == ["ride_id", "counts", "day", "hour", "car_type_is_bus", "travel_from_Northgate",
                          "travel_from_other"]
    test = spark.createDataFrame([(7, "1-2-18", "23:59", "Hilltop", "Bus")],
                                 "ride_id long, travel_date string, travel_time string, travel_from string, car_type string")
    te = align_columns(onehot_features(test, rare=("Tinytown",)), [c for c in tr.columns if c != "counts"])
    assert [tuple(r) for r in te.collect()] == [(7, 1, 23, 1, 0, 0)]


def test_forecast_key_as_feature_and_write(spark, tmpdir_fresh):
    from ridecast.plans.flows import write_forecast
    from ridecast.sources.csv_io import read_csv
    t, s = _tickets(spark), _rides_to_score(spark)
    p = forecast(t, s, cutoff="2017-04-01", bags=1, n_estimators=3, max_depth=3, key_as_feature=True)
    path = write_forecast(p, f"{tmpdir_fresh}/sub", single_file=True)
    back = read_csv(spark, path, schema="ride_id long, number_of_ticket double")
    assert back.columns == ["ride_id", "number_of_ticket"] and back.count() == 3
