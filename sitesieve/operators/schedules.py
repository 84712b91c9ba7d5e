"""Schedules: the next instant of a daily, weekly or monthly run in its own zone, and which are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_run(after: Column, cadence: Column, hour: Column, weekday: Column, day_of_month: Column, tz: Column) -> Column:
    """The first run strictly after ``after`` (UTC), as a UTC instant; Monday is weekday 0, a day beyond the month's end is its last.

    Runs that were missed are one run: only the next instant counts.
    """
    local = F.from_utc_timestamp(after, tz)
    today = F.to_date(local)
    at = lambda day: F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), hour, F.lit(0), F.lit(0)), tz)
    later = lambda first, second: F.when(at(first) > after, at(first)).otherwise(at(second))
    of_week = F.date_add(today, F.pmod(weekday - F.weekday(today), F.lit(7)))
    of_month = lambda day: F.date_add(F.trunc(day, "month"), F.least(day_of_month, F.day(F.last_day(day))) - 1)
    return (
        F.when(cadence == "daily", later(today, F.date_add(today, 1)))
        .when(cadence == "weekly", later(of_week, F.date_add(of_week, 7)))
        .when(cadence == "monthly", later(of_month(today), of_month(F.add_months(F.trunc(today, "month"), 1))))
    )


def due(schedules: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    return schedules.filter(F.col("active") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id").limit(limit)
