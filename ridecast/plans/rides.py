"""Ride features: the fit/transform pair that turns ticket rows (train) and
rides to score (test) into the same numeric feature table.

Steps, in the source's order: count tickets per ride, merge rare origins into
``other``, parse the travel date, drop rides before a cutoff (train only),
add month and ISO week, replace the date by its weekday (Monday = 0), code the
car type and origin with dictionaries fitted on train (unseen/null -> -1),
split the clock string into hour and minute, add the weekend flag.

Everything is one projection over one aggregation; the only job run at fit
time is the (bounded) dictionary fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ridecast.functions.calendar import DEFAULT_DATE_FORMATS, iso_week, parse_date, weekday, weekend_flag
from ridecast.functions.clock import clock_hour, clock_minute
from ridecast.operators.aggregate import ride_counts
from ridecast.operators.encode import CategoryCodes, rare_to_other


@dataclass
class RideSpec:
    """Names of the ride columns in the input frames."""
    ride_id: str = "ride_id"
    travel_date: str = "travel_date"
    travel_time: str | None = "travel_time"
    travel_from: str = "travel_from"
    car_type: str = "car_type"
    extra_keys: tuple = ()

    @property
    def keys(self) -> list[str]:
        ks = [self.ride_id, self.travel_date]
        if self.travel_time:
            ks.append(self.travel_time)
        return ks + [self.travel_from, self.car_type, *self.extra_keys]


@dataclass
class RideFeatures:
    spec: RideSpec = field(default_factory=RideSpec)
    label: str = "number_of_tickets"
    cutoff: str | None = None
    rare: tuple = ()
    other: str = "other"
    date_formats: tuple = DEFAULT_DATE_FORMATS
    drop_columns: tuple = ()
    codes: CategoryCodes | None = None

    # ---- helpers -------------------------------------------------------
    def _date(self, df: DataFrame):
        s = self.spec
        dt = df.schema[s.travel_date].dataType
        if isinstance(dt, StringType):
            return parse_date(s.travel_date, self.date_formats)
        return F.to_date(s.travel_date)

    def _cutoff_filter(self, df: DataFrame) -> DataFrame:
        """Keep rides on/after the cutoff, written so it reaches the scan when
        the date column is a stored date or timestamp."""
        if not self.cutoff:
            return df
        s = self.spec
        dt = df.schema[s.travel_date].dataType
        if isinstance(dt, TimestampNTZType):
            return df.where(F.col(s.travel_date) >= F.lit(self.cutoff).cast("timestamp_ntz"))
        if isinstance(dt, TimestampType):
            return df.where(F.col(s.travel_date) >= F.lit(self.cutoff).cast("timestamp"))
        if isinstance(dt, DateType):
            return df.where(F.col(s.travel_date) >= F.lit(self.cutoff).cast("date"))
        return df.where(self._date(df) >= F.lit(self.cutoff).cast("date"))

    # ---- stages --------------------------------------------------------
    def count_tickets(self, tickets: DataFrame) -> DataFrame:
        """Tickets -> one row per ride with the ticket count (train side).
        The cutoff is on a group key, so it is applied before the aggregation."""
        return ride_counts(self._cutoff_filter(tickets), self.spec.keys, self.label)

    def _base(self, rides: DataFrame, train: bool) -> DataFrame:
        s = self.spec
        df = rides.drop(*[c for c in self.drop_columns if c in rides.columns])
        if train:
            df = self._cutoff_filter(df)
        if self.rare:
            df = rare_to_other(df, list(self.rare), self.other,
                               subset=[c for c in (s.travel_from, s.car_type)])
        d = self._date(df)
        df = df.withColumn("month", F.month(d).cast("int")).withColumn("week", iso_week(d)) \
               .withColumn(s.travel_date, weekday(d))
        if s.travel_time:
            df = df.withColumn("hour_booked", clock_hour(s.travel_time)) \
                   .withColumn("minute_booked", clock_minute(s.travel_time)).drop(s.travel_time)
        return df.withColumn("is_weekend", weekend_flag(s.travel_date))

    def fit(self, train_rides: DataFrame) -> "RideFeatures":
        base = self._base(train_rides, train=True)
        self.codes = CategoryCodes([self.spec.car_type, self.spec.travel_from]).fit(base)
        return self

    def fit_tickets(self, tickets: DataFrame) -> "RideFeatures":
        """Fit the dictionaries straight from the ticket rows.  Counting per
        ride does not change which category values occur, so the distinct
        values of the kept tickets (cutoff applied, rows with a null key
        dropped, rare values merged) equal those of the counted rides, and the
        fit skips the ride aggregation (a distinct over two low-cardinality
        columns, combined map-side)."""
        s = self.spec
        kept = self._cutoff_filter(tickets).dropna(subset=s.keys).select(s.travel_from, s.car_type)
        if self.rare:
            kept = rare_to_other(kept, list(self.rare), self.other)
        self.codes = CategoryCodes([s.car_type, s.travel_from]).fit(kept)
        return self

    def transform(self, rides: DataFrame, train: bool = False) -> DataFrame:
        if self.codes is None:
            raise RuntimeError("fit first")
        return self.codes.transform(self._base(rides, train=train))

    def fit_transform(self, train_rides: DataFrame) -> DataFrame:
        return self.fit(train_rides).transform(train_rides, train=True)

    def feature_columns(self, df: DataFrame, key: bool = False) -> list[str]:
        drop = {self.label} | ({self.spec.ride_id} if not key else set())
        return [c for c in df.columns if c not in drop]
