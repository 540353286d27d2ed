"""Column -> Column helpers.  All are built from pyspark.sql.functions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from ridecast.functions.calendar import (  # noqa: F401
    add_years, as_date, day_part, hour_band, iso_week, parse_date, weekday, weekday_from_name,
    weekend_flag,
)
from ridecast.functions.clock import clock_hour, clock_minute, clock_text, time_to_minutes  # noqa: F401
from ridecast.functions.mathx import floor_rule, half_even, threshold_label  # noqa: F401
