"""Streaming ride counts equal the batch counts once the watermark passes."""

import datetime as dt

from pyspark.sql import functions as F

from ridecast.operators.aggregate import ride_counts
from ridecast.streaming import ride_counts_stream, start_ride_counts


def test_stream_counts_match_batch(spark, tmpdir_fresh):
    src = f"{tmpdir_fresh}/tickets"
    base = dt.datetime(2017, 4, 1)
    rows = [(i % 7, base + dt.timedelta(days=i % 5), "A" if i % 2 else "B") for i in range(60)]
    df = spark.createDataFrame(rows, "ride_id long, travel_date timestamp, travel_from string")
    df.where(F.col("travel_date") < dt.datetime(2017, 4, 3)).coalesce(1).write.parquet(f"{src}/part1")
    df.where(F.col("travel_date") >= dt.datetime(2017, 4, 3)).coalesce(1).write.parquet(f"{src}/part2")
    # a late-arriving far-future ticket advances the watermark past every ride
    spark.createDataFrame([(99, dt.datetime(2018, 1, 1), "A")], df.schema).coalesce(1).write.parquet(f"{src}/part3")
    keys = ["ride_id", "travel_date", "travel_from"]
    stream = ride_counts_stream(spark, f"{src}/*", df.schema, keys, "travel_date", delay="1 day",
                                max_files_per_trigger=1)
    q = start_ride_counts(stream, None, f"{tmpdir_fresh}/ckpt", fmt="memory", query_name="rc_test")
    q.processAllAvailable()
    q.stop()
    got = {(r.ride_id, r.travel_date, r.travel_from): r.number_of_tickets for r in spark.table("rc_test").collect()}
    exp = {(r.ride_id, r.travel_date, r.travel_from): r.number_of_tickets for r in ride_counts(df, keys).collect()}
    assert got == exp
