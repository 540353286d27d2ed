"""Fit on train tickets, apply to rides to score: codes from train only,
unseen -> -1, same merge list on both sides, cutoff on train only."""

from ridecast.plans.rides import RideFeatures, RideSpec


def test_ride_features_fit_transform(spark):
    tickets = spark.createDataFrame(
        [(1, "17-10-17", "7:15", "Northgate", "Bus"), (1, "17-10-17", "7:15", "Northgate", "Bus"),
         (2, "2017-11-19", "8:05", "Eastport", "shuttle"), (3, "1-1-17", "5:10", "Eastport", "Bus"),
         (4, "3-4-17", "23:59", "Smallville", "shuttle"), (5, "2-4-17", "0:05", None, "Bus")],
        "ride_id long, travel_date string, travel_time string, travel_from string, car_type string")
    rf = RideFeatures(spec=RideSpec(), cutoff="2017-04-01", rare=("Smallville", "Tinytown"))
    train = rf.fit_transform(rf.count_tickets(tickets))
    rows = {r.ride_id: r for r in train.collect()}
    assert set(rows) == {1, 2, 4}                        # 3 before cutoff, 5 has a null key
    assert rows[1].number_of_tickets == 2
    assert rf.codes.categories("travel_from") == ["Eastport", "Northgate", "other"]
    assert (rows[1].travel_from, rows[4].travel_from) == (1, 2)
    assert (rows[1].travel_date, rows[1].month, rows[1].week, rows[1].is_weekend) == (1, 10, 42, 0)
    assert (rows[2].travel_date, rows[2].is_weekend, rows[2].hour_booked, rows[2].minute_booked) == (6, 1, 8, 5)

    score = spark.createDataFrame([(10, "1-2-18", "6:00", "Tinytown", "Bus"), (11, "2018-2-3", "7:00", "Capital", "van")],
                                  "ride_id long, travel_date string, travel_time string, travel_from string, "
                                  "car_type string")
    s = {r.ride_id: r for r in rf.transform(score).collect()}
    assert s[10].travel_from == 2                         # merged to "other", seen
    assert (s[11].travel_from, s[11].car_type) == (-1, -1)  # unseen


def test_fit_from_tickets_equals_fit_on_rides(spark):
    tickets = spark.createDataFrame(
        [(1, "17-10-17", "7:15", "Northgate", "Bus"), (2, "2017-11-19", "8:05", "Eastport", "shuttle"),
         (3, "1-1-17", "5:10", "Riverside", "Bus"), (4, "3-4-17", "23:59", "Smallville", "van"),
         (5, "2-4-17", None, "Lakeside", "Bus")],
        "ride_id long, travel_date string, travel_time string, travel_from string, car_type string")
    a = RideFeatures(spec=RideSpec(), cutoff="2017-04-01", rare=("Smallville",))
    b = RideFeatures(spec=RideSpec(), cutoff="2017-04-01", rare=("Smallville",))
    a.fit(a.count_tickets(tickets))
    b.fit_tickets(tickets)
    for c in ("travel_from", "car_type"):
        assert a.codes.categories(c) == b.codes.categories(c)
    assert "Riverside" not in b.codes.categories("travel_from") and "Lakeside" not in b.codes.categories("travel_from")
