"""Calendar expressions that do not depend on the session time zone for naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR = 3600
DAY = 86400


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of the wall-clock time."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60 + F.second(ts)


def floor_hour(ts: Column) -> Column:
    """Start of the hour, kept as a naive timestamp."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def floor_day(ts: Column) -> Column:
    """Start of the day, kept as a naive timestamp."""
    return F.to_date(ts).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole hours from ``earlier`` to ``later``."""
    return F.floor((epoch_seconds(later) - epoch_seconds(earlier)) / HOUR)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The seven calendar features: ISO week, Monday = 0 weekday, and week of month as ceil(day / 7)."""
    return {
        "month_datetime": F.month(ts),
        "weekofyear_datetime": F.weekofyear(ts),
        "dayofyear_datetime": F.dayofyear(ts),
        "hour_datetime": F.hour(ts),
        "day_week": F.weekday(ts),
        "day_month_datetime": F.dayofmonth(ts),
        "week_month_datetime": F.ceil(F.dayofmonth(ts) / F.lit(7)).cast("int"),
    }
