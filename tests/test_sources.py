"""CSV scan/sink and the union + year-shift golden (copy-free generator of the
same shape as the six quarterly daily files)."""

import datetime as dt

from pyspark.sql import functions as F

from ridecast.operators.enrich import union_all, year_shift_union
from ridecast.sources.csv_io import read_csv, write_csv
from ridecast.sources.travel import (
    DAILY_FILE_SCHEMA, MEASURE_COLUMNS, daily_file_frame, read_daily_files,
)

# Fixed test parameters: (file label, first date, rows) of each quarterly daily
# file; each starts the day before its quarter, and the 10-12 file repeats
# 2017-09-29.
QUARTER_FILES = [("2017-1-3", dt.date(2016, 12, 31), 90), ("2017-4-6", dt.date(2017, 3, 31), 91),
                 ("2017-7-9", dt.date(2017, 6, 30), 92), ("2017-10-12", dt.date(2017, 9, 29), 91),
                 ("2018-1-3", dt.date(2017, 12, 31), 87), ("2018-4-6", dt.date(2018, 3, 31), 91)]


def _write_quarter_files(spark, base):
    paths = {}
    for label, start, n in QUARTER_FILES:
        rows = [(start + dt.timedelta(days=i),) for i in range(n)]
        df = spark.createDataFrame(rows, "date date")
        for j, c in enumerate(MEASURE_COLUMNS):
            df = df.withColumn(c, (F.dayofyear("date") * 10 + j).cast("int"))
        path = f"{base}/{label}"
        daily_file_frame(df).drop("quarter").coalesce(1).write.option("header", True).csv(path)
        paths[label] = path
    return paths


def test_csv_roundtrip_embedded_commas(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, "North Quay, Gate 2", 3.5), (2, 'quote "x"', None)],
                               "ride_id long, name string, number_of_ticket double")
    p = write_csv(df, f"{tmpdir_fresh}/out", single_file=True)
    back = read_csv(spark, p, schema="ride_id long, name string, number_of_ticket double")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "North Quay, Gate 2", 3.5),
                                                                      (2, 'quote "x"', None)]
    inferred = read_csv(spark, p, infer=True)
    assert dict(inferred.dtypes)["ride_id"] == "int"


def test_daily_files_union_and_shift_golden(spark, tmpdir_fresh):
    paths = _write_quarter_files(spark, tmpdir_fresh)
    order = ["2017-4-6", "2017-7-9", "2017-10-12", "2018-1-3", "2018-4-6", "2017-1-3"]
    six = read_daily_files(spark, [paths[k] for k in order])
    assert six.count() == 542
    assert six.where(F.col("date") == dt.date(2017, 9, 29)).count() == 2      # overlap kept (bag union)
    u = year_shift_union(six.select("date", F.col("daily_mean").alias("city_travel_time")), ["date"],
                         after="2017-06-29")
    assert u.count() == 542 + 361
    five = read_daily_files(spark, [paths[k] for k in order[:5]])
    u5 = year_shift_union(five.select("date", "daily_mean"), ["date"], after="2017-06-30", before="2018-01-01")
    assert five.count() == 452 and u5.count() == 452 + 183


def test_daily_file_schema_reads_quoted_names(spark, tmpdir_fresh):
    paths = _write_quarter_files(spark, tmpdir_fresh)
    raw = read_csv(spark, paths["2017-1-3"], schema=DAILY_FILE_SCHEMA)
    r = raw.first()
    assert "," in r["Origin Display Name"] and "/" in r["Date"]
    parsed = read_daily_files(spark, [paths["2017-1-3"]])
    assert parsed.agg(F.min("date")).first()[0] == dt.date(2016, 12, 31)


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, id int")
    assert sorted(map(tuple, union_all([a, b, a]).collect())) == [(1, "x"), (1, "x"), (2, "y")]
