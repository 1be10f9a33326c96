"""Dates, decay and ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = "2014-01-01"
DECAY = 0.1


def parse_day(stamp: Column) -> Column:
    """Days since 1970-01-01 of a year, a date or a date and time; null if it is none. A year is its first day."""
    date = F.when(F.length(stamp) == 4, F.concat(stamp, F.lit("-01-01"))).otherwise(F.substring(stamp, 1, 10))
    return F.unix_date(F.try_to_date(date, "yyyy-MM-dd")).cast("long")


def days_since_base(date: Column, base: str = BASE) -> Column:
    return F.date_diff(date, F.lit(base).cast("date")).cast("long")


def date_of_days(days: Column, base: str = BASE) -> Column:
    return F.date_format(F.date_add(F.lit(base).cast("date"), days.cast("int")), "yyyy-MM-dd")


def clamp_date(stamp: Column) -> Column:
    """YYYY-MM-DD with a day beyond the month's last brought down to it; anything else unchanged."""
    month = F.try_to_date(F.concat(F.substring(stamp, 1, 8), F.lit("01")), "yyyy-MM-dd")
    last = F.date_format(F.last_day(month), "yyyy-MM-dd")
    form = stamp.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(form & month.isNotNull() & (stamp > last), last).otherwise(stamp)


def decay(day: Column, target: Column, rate: float = DECAY) -> Column:
    return F.exp(-F.lit(rate) * F.abs(target - day))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)
