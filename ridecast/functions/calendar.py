"""Calendar helpers: date parsing with explicit formats, weekday (Monday = 0),
ISO week, year shifts, weekend flag, hour bands and day parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

# The two formats the ticket files use, tried in this order
# (day-first two-digit year, then ISO-like year-month-day).
DEFAULT_DATE_FORMATS = ("d-M-yy", "yyyy-M-d")

# Fixed value: two-digit years 69..99 belong to the 1900s, 00..68 to the 2000s
# (the POSIX %y rule).  Spark's "yy" always maps to 2000..2099.
TWO_DIGIT_YEAR_PIVOT = 2069

# Weekday names in Monday = 0 order.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Hour bands used to pick a travel-time triple, as
# (name, first hour inclusive, last hour exclusive).  Hour 0 belongs to
# "Early Morning" (the source left it unmatched).
DEFAULT_HOUR_BANDS = (
    ("AM", 7, 10),
    ("Midday", 10, 14),
    ("PM", 14, 19),
    ("Evening", 19, 24),
    ("Early Morning", 0, 7),
)

# Six-way day parts on fractional hours (minutes / 60):
# code 1 = [7,10), 2 = [10,14), 3 = [14,19), 4 = [19,24], 5 = [1,7), otherwise 6.
DAY_PARTS = ((1, 7, 10, False), (2, 10, 14, False), (3, 14, 19, False), (4, 19, 24, True), (5, 1, 7, False))
DAY_PART_OTHER = 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parse_one(s: Column, fmt: str) -> Column:
    d = F.try_to_date(s, fmt)
    if "yy" in fmt and "yyyy" not in fmt:
        d = F.when(F.year(d) >= TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_date(c, formats=DEFAULT_DATE_FORMATS, strict: bool = True) -> Column:
    """String -> date, trying ``formats`` in order.  With ``strict`` a non-null
    string that matches none of them raises, as the source's parser does."""
    s = _col(c)
    tries = [_parse_one(s, f) for f in formats]
    if strict:
        tries.append(F.when(s.isNotNull(), F.raise_error(F.concat(F.lit("unparseable date: "), s))))
    return F.coalesce(*tries).cast(DateType())


def as_date(c, dtype=None, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Date from a string, date or timestamp column (no session-zone shift for
    timestamp_ntz)."""
    s = _col(c)
    if isinstance(dtype, StringType):
        return parse_date(s, formats)
    return F.to_date(s)


def weekday(c) -> Column:
    """Monday = 0 ... Sunday = 6 (not ``dayofweek``, which is Sunday = 1)."""
    return F.weekday(_col(c)).cast("int")


def iso_week(c) -> Column:
    return F.weekofyear(_col(c)).cast("int")


def add_years(c, years: int = 1) -> Column:
    """Calendar shift; Feb 29 + 1 year -> Feb 28."""
    return F.add_months(_col(c), 12 * years)


def weekend_flag(dow) -> Column:
    return F.when(_col(dow) >= 5, 1).otherwise(0).cast("int")


def weekday_from_name(c) -> Column:
    """'Monday' -> 0 ... 'Sunday' -> 6; anything else -> null."""
    s = _col(c)
    expr = None
    for i, name in enumerate(WEEKDAY_NAMES):
        expr = (F.when(s == name, F.lit(i)) if expr is None else expr.when(s == name, F.lit(i)))
    return expr.cast("int")


def hour_band(hour, bands=DEFAULT_HOUR_BANDS) -> Column:
    """Name of the band an hour falls in; null when none matches."""
    h = _col(hour)
    expr = None
    for name, lo, hi in bands:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def day_part(minutes) -> Column:
    """Six-way day part code of a clock time given in minutes after midnight."""
    t = _col(minutes) / 60.0
    expr = None
    for code, lo, hi, closed in DAY_PARTS:
        cond = (t >= lo) & ((t <= hi) if closed else (t < hi))
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit(DAY_PART_OTHER)).cast("int")
