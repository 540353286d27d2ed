"""Travel-time tables.

The ticket data is enriched with a city travel-time table: one row per day with
a mean / lower / upper triple for the whole day and for five day parts, a
per-weekday summary per quarter, and a per-day-part summary.  Here the tables
are derived from ``lineitem`` (ship date = day, ``l_extendedprice`` = travel
time, ``l_linenumber`` 1..5 = the five day parts) so that every query built on
them reads the given tables and grows with them.

All derivations are one grouped aggregation with conditional aggregates:
partial aggregation runs map-side and the shuffle carries one row per
(partition, day), so a day that holds a third of all rows costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ridecast.functions.calendar import WEEKDAY_NAMES
from ridecast.sources.csv_io import read_csv_many

# Band names of the daily file, in file order.
BANDS = ("Daily", "AM", "PM", "Midday", "Evening", "Early Morning")
# Column-name stems used inside the library for the same bands.
BAND_KEYS = ("daily", "am", "pm", "midday", "evening", "early_morning")
# Stand-in rule: lineitem line number that feeds each day-part band (Daily = all lines).
BAND_LINE = {"am": 1, "pm": 2, "midday": 3, "evening": 4, "early_morning": 5}

# Origin / destination identity written into every daily file
# (display names carry an embedded comma, as in the source files).
ORIGIN_ID, ORIGIN_NAME = "100", "Central Station, Zone A"
DEST_ID, DEST_NAME = "200", "Airport Road, Zone B"


def band_header(band: str, part: str) -> str:
    """Header text of one measure column of the daily file."""
    if part == "mean":
        return f"{band} Mean Travel Time (Seconds)"
    bound = "Lower" if part == "lower" else "Upper"
    return f"{band} Range - {bound} Bound Travel Time (Seconds)"


ID_COLUMNS = ("date", "origin_id", "origin_name", "destination_id", "destination_name")
ID_HEADERS = ("Date", "Origin Movement ID", "Origin Display Name", "Destination Movement ID",
              "Destination Display Name")
MEASURE_COLUMNS = tuple(f"{k}_{p}" for k in BAND_KEYS for p in ("mean", "lower", "upper"))
MEASURE_HEADERS = tuple(band_header(b, p) for b in BANDS for p in ("mean", "lower", "upper"))

DAILY_FILE_SCHEMA = StructType(
    [StructField(h, StringType()) for h in ID_HEADERS]
    + [StructField(h, IntegerType()) for h in MEASURE_HEADERS]
)


def _measure(x):
    return F.floor(x).cast("int")


def daily_travel_times(lineitem: DataFrame) -> DataFrame:
    """One row per ship date: date plus 18 integer measures (snake-case names)."""
    x = F.col("l_extendedprice")
    aggs = [_measure(F.avg(x)).alias("daily_mean"), _measure(F.min(x)).alias("daily_lower"),
            _measure(F.max(x)).alias("daily_upper")]
    for k in BAND_KEYS[1:]:
        sel = F.when(F.col("l_linenumber") == BAND_LINE[k], x)
        aggs += [_measure(F.avg(sel)).alias(f"{k}_mean"), _measure(F.min(sel)).alias(f"{k}_lower"),
                 _measure(F.max(sel)).alias(f"{k}_upper")]
    return (lineitem.where(F.col("l_shipdate").isNotNull())
            .groupBy(F.to_date("l_shipdate").alias("date")).agg(*aggs))


def daily_file_frame(daily: DataFrame) -> DataFrame:
    """Daily table in file layout: ``MM/dd/yyyy`` text date, identity columns,
    header-named measures, plus the quarter used to split files."""
    cols = [F.date_format("date", "MM/dd/yyyy").alias("Date"),
            F.lit(ORIGIN_ID).alias("Origin Movement ID"), F.lit(ORIGIN_NAME).alias("Origin Display Name"),
            F.lit(DEST_ID).alias("Destination Movement ID"), F.lit(DEST_NAME).alias("Destination Display Name")]
    cols += [F.col(c).alias(h) for c, h in zip(MEASURE_COLUMNS, MEASURE_HEADERS)]
    quarter = F.concat(F.year("date").cast("string"), F.lit("-q"), F.quarter("date").cast("string"))
    return daily.select(*cols, quarter.alias("quarter"))


def write_daily_files(daily: DataFrame, base: str) -> str:
    """One folder of CSV files per quarter (``base/quarter=YYYY-qN``)."""
    daily_file_frame(daily).write.mode("overwrite").partitionBy("quarter") \
        .option("header", True).option("quote", '"').option("escape", '"').csv(base)
    return base


def read_daily_files(spark: SparkSession, paths) -> DataFrame:
    """Read a list of daily files in one scan, rename positionally to the
    library's column names and parse the ``MM/dd/yyyy`` date."""
    raw = read_csv_many(spark, paths, schema=DAILY_FILE_SCHEMA)
    named = raw.toDF(*ID_COLUMNS, *MEASURE_COLUMNS)
    return named.withColumn("date", F.to_date("date", "MM/dd/yyyy"))


def weekday_travel_times(lineitem: DataFrame) -> DataFrame:
    """Per quarter and weekday summary in file layout: weekday name, a
    ``M/d/yyyy - M/d/yyyy, Daily Average`` range text and a mean/lower/upper triple."""
    d = F.to_date("l_shipdate")
    x = F.col("l_extendedprice")
    g = (lineitem.where(F.col("l_shipdate").isNotNull())
         .groupBy(F.trunc(d, "quarter").alias("q_start"), F.weekday(d).alias("dow"))
         .agg(_measure(F.avg(x)).alias("mean_travel_day"), _measure(F.min(x)).alias("lower_travel_day"),
              _measure(F.max(x)).alias("upper_travel_day")))
    q_end = F.last_day(F.add_months("q_start", 2))
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    rng = F.concat(F.date_format("q_start", "M/d/yyyy"), F.lit(" - "), F.date_format(q_end, "M/d/yyyy"),
                   F.lit(", Daily Average"))
    return g.select(F.element_at(names, F.col("dow") + 1).alias("day_of_week_name"), rng.alias("date_range"),
                    "mean_travel_day", "lower_travel_day", "upper_travel_day")


def parse_date_range(df: DataFrame, col: str = "date_range") -> DataFrame:
    """``M/d/yyyy - M/d/yyyy, <text>`` -> ``date_start``, ``date_end``."""
    span = F.split(F.col(col), ",", 2).getItem(0)
    ends = F.split(span, " - ", 2)
    return (df.withColumn("date_start", F.to_date(F.trim(ends.getItem(0)), "M/d/yyyy"))
              .withColumn("date_end", F.to_date(F.trim(ends.getItem(1)), "M/d/yyyy")))
