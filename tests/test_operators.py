import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridecast.operators.aggregate import counts_below, day_of_month_mean, fill_with_mean, ride_counts
from ridecast.operators.encode import CategoryCodes, align_columns, auto_features, one_hot, rare_to_other
from ridecast.operators.enrich import band_join, hour_band_pick, left_join_on, year_shift_union
from ridecast.operators.folds import hash_folds, holdout_split, kfold_ntile, kfold_stratified
from ridecast.operators.metrics import class_metrics, cv_mean_score, regression_metrics
from ridecast.operators.rank import global_rank
from ridecast.operators.scale import minmax_scale, standard_scale

D = dt.date


def tickets_fixture(spark):
    rows = [(1, "17-10-17", "7:15", "Northgate", "Bus", 49), (1, "17-10-17", "7:15", "Northgate", "Bus", 49),
            (1, "17-10-17", "7:15", "Northgate", "Bus", 49), (2, "2017-11-19", "8:00", "Eastport", "shuttle", 11),
            (2, "2017-11-19", "8:00", "Eastport", "shuttle", 11), (3, "1-1-17", "5:10", None, "Bus", 49),
            (4, None, "6:00", "Bayside", "Bus", 49), (5, "30-3-17", "23:59", "Hilltop", "shuttle", 11)]
    return spark.createDataFrame(rows, "ride_id long, travel_date string, travel_time string, travel_from string, "
                                       "car_type string, max_capacity int")


def test_ride_counts_drops_null_keys(spark):
    t = tickets_fixture(spark)
    c = ride_counts(t, ["ride_id", "travel_date", "travel_time", "travel_from", "car_type"])
    got = {r.ride_id: r.number_of_tickets for r in c.collect()}
    assert got == {1: 3, 2: 2, 5: 1}
    assert [r.ride_id for r in counts_below(c, "number_of_tickets", 3).collect()] != []
    assert {r.ride_id for r in counts_below(c, "number_of_tickets", 2).collect()} == {5}


@pytest.mark.parametrize("inline,bcast", [(1024, 200000), (0, 200000), (0, 0)])
def test_category_codes_all_paths(spark, inline, bcast):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    test = spark.createDataFrame([(1, "c"), (2, "z"), (3, None), (4, "a")], "id int, v string")
    codes = CategoryCodes(["v"], inline_limit=inline, broadcast_limit=bcast).fit(train)
    got = {r.id: r.v for r in codes.transform(test).collect()}
    assert got == {1: 2, 2: -1, 3: -1, 4: 0}


def test_category_codes_code_point_order(spark):
    train = spark.createDataFrame([("b",), ("B",), ("a",), ("Z",)], "v string")
    codes = CategoryCodes(["v"]).fit(train)
    assert codes.categories("v") == ["B", "Z", "a", "b"]


def test_one_hot_and_align(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, c string")
    oh = one_hot(df, "c", prefix="p")
    assert oh.columns == ["id", "p_x", "p_y"]
    assert [tuple(r) for r in oh.orderBy("id").collect()] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    test = one_hot(spark.createDataFrame([(4, "y"), (5, "w")], "id int, c string"), "c", prefix="p")
    al = align_columns(test, oh.columns)
    assert al.columns == oh.columns
    assert [tuple(r) for r in al.orderBy("id").collect()] == [(4, 0, 1), (5, 0, 0)]


def test_rare_to_other_every_string_column(spark):
    df = spark.createDataFrame([("Smallville", "Eastport", 1), ("Northgate", "Tinytown", 2)], "a string, b string, n int")
    out = rare_to_other(df, ["Smallville", "Tinytown"])
    assert [tuple(r) for r in out.collect()] == [("other", "Eastport", 1), ("Northgate", "other", 2)]


def test_scalers(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "id int, x double, c double")
    s = standard_scale(df, ["x"]).orderBy("id").collect()
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose([r.x for r in s], (x - x.mean()) / x.std())          # population std
    m = minmax_scale(df, "x").orderBy("id").collect()
    assert [r.x for r in m] == [0.0, 1 / 3, 1.0]
    assert {r.c for r in minmax_scale(df, "c").collect()} == {0.0}          # constant -> 0


def test_year_shift_union(spark):
    df = spark.createDataFrame([(D(2017, 6, 30), 1), (D(2017, 7, 1), 2), (D(2017, 12, 31), 3), (D(2016, 2, 29), 4)],
                               "d date, v int")
    out = year_shift_union(df, ["d"], after="2017-06-30", before="2018-01-01")
    assert sorted((r.d, r.v) for r in out.collect()) == sorted(
        [(D(2017, 6, 30), 1), (D(2017, 7, 1), 2), (D(2017, 12, 31), 3), (D(2016, 2, 29), 4),
         (D(2018, 7, 1), 2), (D(2018, 12, 31), 3)])


def test_band_join_matches_brute_force(spark):
    rides = [(i, D(2017, 1, 1) + dt.timedelta(days=i % 60)) for i in range(200)] + [(999, None)]
    rdf = spark.createDataFrame(rides, "id int, d date").withColumn("dow", F.weekday("d"))
    bands = [(w, D(2017, 1, 1), D(2017, 1, 31), 10 + w) for w in range(7)] + \
            [(w, D(2017, 1, 20), D(2017, 2, 15), 20 + w) for w in range(0, 7, 2)] + \
            [(3, D(2017, 2, 10), D(2017, 2, 1), 99)]                       # empty band (start > end)
    bdf = spark.createDataFrame(bands, "day_of_week int, date_start date, date_end date, m int")
    got = sorted((r.id, r.m) for r in band_join(rdf, bdf, "d", "dow", take=["m"]).collect())
    exp = sorted((i, m) for i, d in rides if d is not None for w, s, e, m in bands
                 if d.weekday() == w and s <= d <= e)
    assert got == exp


def test_left_join_fill_and_day_mean(spark):
    daily = spark.createDataFrame([(D(2017, 1, 5), 10.0), (D(2017, 2, 5), 20.0), (D(2017, 1, 6), 30.0)],
                                  "date date, t double")
    dm = {r.day: r.t for r in day_of_month_mean(daily, "date").collect()}
    assert dm == {5: 15.0, 6: 30.0}
    rides = spark.createDataFrame([(1, D(2017, 1, 5)), (2, D(2017, 3, 1))], "id int, travel_date date")
    j = left_join_on(rides, daily, "travel_date", "date")
    assert "date" not in j.columns
    f = {r.id: r.t for r in fill_with_mean(j, "t").collect()}
    assert f == {1: 10.0, 2: 10.0}


def test_hour_band_pick(spark):
    names = {b: (f"{b}_m", f"{b}_l", f"{b}_u") for b in ("AM", "Midday", "PM", "Evening", "Early Morning")}
    cols = {c: float(i) for i, c in enumerate(x for v in names.values() for x in v)}
    rows = [(h, *cols.values()) for h in (0, 7, 13, 18, 23)]
    schema = "hour int, " + ", ".join(f"`{c}` double" for c in cols)
    df = spark.createDataFrame(rows, schema)
    out = hour_band_pick(df, "hour", names).orderBy("hour").collect()
    assert [(r.hour_mean_time, r.hour_max_time) for r in out] == [
        (cols["Early Morning_m"], cols["Early Morning_u"]), (cols["AM_m"], cols["AM_u"]),
        (cols["Midday_m"], cols["Midday_u"]), (cols["PM_m"], cols["PM_u"]), (cols["Evening_m"], cols["Evening_u"])]


def test_global_rank_and_folds_match_windows(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7919 % 1003).alias("k"), (F.col("id") % 3).alias("g"))
    df = df.repartition(5)
    r = {row.k: row.rank0 for row in global_rank(df, ["k"], partitions=4).collect()}
    assert r == {k: k for k in range(1003)}
    for k in (2, 3, 5, 7):
        got = {row.k: row.fold for row in kfold_ntile(df, "k", k=k).collect()}
        exp = {row.k: row.f for row in df.select("k", (F.ntile(k).over(Window.orderBy("k")) - 1).alias("f")).collect()}
        assert got == exp
    got = {row.k: row.fold for row in kfold_stratified(df, "k", "g", k=4).collect()}
    w = Window.partitionBy("g").orderBy("k")
    exp = {row.k: row.f for row in df.select("k", ((F.row_number().over(w) - 1) % 4).alias("f")).collect()}
    assert got == exp


def test_holdout_and_hash_folds(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "key")
    s = holdout_split(df, "key", test_size=0.3, seed=1)
    assert s.where("is_test = 1").count() == 31                             # ceil(101 * 0.3)
    s2 = holdout_split(df, "key", test_size=0.3, seed=1)
    assert sorted(r.key for r in s.where("is_test = 1").collect()) == sorted(r.key for r in s2.where("is_test = 1").collect())
    o = holdout_split(df, "key", test_size=0.25, shuffle=False)
    assert sorted(r.key for r in o.where("is_test = 1").collect()) == list(range(75, 101))
    h = hash_folds(df, "key", k=5)
    assert {r.fold for r in h.collect()} <= set(range(5))


def test_metrics_against_numpy(spark):
    y = np.array([3.0, 5.0, 7.0, 1.0, 10.0])
    p = np.array([2.5, 5.5, 6.0, 1.0, 12.0])
    df = spark.createDataFrame([(float(a), float(b), i % 2) for i, (a, b) in enumerate(zip(y, p))],
                               "y double, p double, fold int")
    m = regression_metrics(df).first()
    assert m.mae == pytest.approx(np.abs(y - p).mean())
    assert m.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert m.explained_variance == pytest.approx(1 - np.var(y - p) / np.var(y))
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    rm = regression_metrics(df, round_pred=True).first()
    assert rm.mae == pytest.approx(np.abs(y - np.round(p)).mean())
    cv = cv_mean_score(df).first()
    per = [np.abs(y[i::2] - p[i::2]).mean() for i in (0, 1)]
    assert cv.cv_mae == pytest.approx(sum(per) / 2)
    c = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.2), (0, 0, 0.7)], "y int, p int, pt double")
    cm = class_metrics(c, prob="pt").first()
    assert cm.accuracy == pytest.approx(2 / 3)
    assert cm.log_loss == pytest.approx(-np.mean(np.log([0.9, 0.2, 0.7])))


def test_auto_features(spark):
    df = spark.createDataFrame([(2, D(2017, 1, 1), "big bus"), (1, D(2017, 1, 2), "")], "k int, d date, s string")
    out = auto_features(df, index="train_index", order=["k"]).orderBy("k").collect()
    assert [(r["WEEKDAY(d)"], r["NUM_WORDS(s)"], r["NUM_CHARACTERS(s)"], r.train_index) for r in out] == \
        [(0, 0, 0, 0), (6, 2, 7, 1)]


def test_skewed_key_counts_spread(spark):
    """A key holding a third of the rows still aggregates exactly."""
    n = 3000
    df = spark.range(0, n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("ride_id"))
    c = {r.ride_id: r.number_of_tickets for r in ride_counts(df, ["ride_id"]).collect()}
    assert c[0] == n // 3 and sum(c.values()) == n



def test_band_join_shuffle_fallback(spark):
    """Above the broadcast limit the band join stays exact as a shuffle join."""
    rides = [(i, D(2017, 1, 1) + dt.timedelta(days=i % 40)) for i in range(120)]
    rdf = spark.createDataFrame(rides, "id int, d date").withColumn("dow", F.weekday("d"))
    bands = [(w, D(2017, 1, 1), D(2017, 2, 28), w) for w in range(7)]
    bdf = spark.createDataFrame(bands, "day_of_week int, date_start date, date_end date, m int")
    a = sorted(map(tuple, band_join(rdf, bdf, "d", "dow", take=["m"], max_rows=0).select("id", "m").collect()))
    b = sorted(map(tuple, band_join(rdf, bdf, "d", "dow", take=["m"]).select("id", "m").collect()))
    assert a == b and len(a) == 120


def test_left_join_dedupe(spark):
    ref = spark.createDataFrame([(D(2017, 9, 29), 10.0), (D(2017, 9, 29), 20.0), (D(2017, 9, 30), 5.0)],
                                "date date, t double")
    rides = spark.createDataFrame([(1, D(2017, 9, 29)), (2, D(2017, 9, 30))], "id int, travel_date date")
    fan = left_join_on(rides, ref, "travel_date", "date")
    assert fan.count() == 3                                   # bag semantics: the repeated date fans out
    one = {r.id: r.t for r in left_join_on(rides, ref, "travel_date", "date", dedupe=True).collect()}
    assert one == {1: 15.0, 2: 5.0}


def test_band_join_hot_date_under_skew_split(spark):
    """One date holds a third of all rides; with the shuffle fallback and AQE's
    skew-join thresholds lowered, the split plan stays exact."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 3000
        rides = spark.range(0, n).select(
            F.col("id").alias("id"),
            F.when(F.col("id") % 3 == 0, F.lit(D(2017, 1, 4)))
             .otherwise(F.date_add(F.lit(D(2017, 1, 1)), (F.col("id") % 50).cast("int"))).alias("d"))
        rides = rides.withColumn("dow", F.weekday("d"))
        bands = spark.createDataFrame([(w, D(2017, 1, 1), D(2017, 3, 1), w * 10) for w in range(7)],
                                      "day_of_week int, date_start date, date_end date, m int")
        got = band_join(rides, bands, "d", "dow", take=["m"], max_rows=0).groupBy().agg(
            F.count(F.lit(1)).alias("n"), F.sum("m").alias("s")).first()
        exp = rides.select((F.col("dow") * 10).alias("m")).groupBy().agg(
            F.count(F.lit(1)).alias("n"), F.sum("m").alias("s")).first()
        assert (got.n, got.s) == (exp.n, exp.s) == (n, exp.s)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_category_codes_nan_is_null(spark):
    rows = [(float("nan"),), (2.0,), (None,), (1.0,), (3.0,)]
    df = spark.createDataFrame(rows, "v double")
    for limits in ({}, {"inline_limit": 0}, {"inline_limit": 0, "broadcast_limit": 0}):
        out = CategoryCodes(["v"], **limits).fit_transform(df, suffix="_code")
        got = [(None if r["v"] is None or r["v"] != r["v"] else r["v"], r["v_code"]) for r in out.collect()]
        assert sorted(got, key=lambda r: (r[1], r[0] or 0)) == [(None, -1), (None, -1), (1.0, 0), (2.0, 1), (3.0, 2)]
