"""Calendars: years of 366 days and back, days since a reference date."""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Periodicity
from .grid import period_of

LEAP_DAY = 60


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def to_366(df: DataFrame, value: str = "value", time: str = "time", keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """(keys, year, day_366, value): every year gets a day 60; where there was none, the mean of its neighbours.

    The extra rows come from the Feb 28 rows and the value after them, so one window serves all.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(
        *keys,
        F.year(time).alias("year"),
        period_of(F.col(time), Periodicity.daily).alias("day_366"),
        F.col(value).alias("value"),
        F.lead(value).over(w).alias("__next"),
    )
    gap = (F.col("day_366") == LEAP_DAY - 1) & ~is_leap(F.col("year"))
    own = F.struct("day_366", "value")
    made = F.struct(F.lit(LEAP_DAY).alias("day_366"), ((F.col("value") + F.col("__next")) / 2).alias("value"))
    both = F.explode(F.when(gap, F.array(own, made)).otherwise(F.array(own)))
    return rows.select(*keys, "year", both.alias("x")).select(*keys, "year", "x.*")


def to_gregorian(df: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """(keys, time, value) of (keys, year, day_366, value): drops day 60 of years that have none."""
    year, day = F.col("year"), F.col("day_366")
    real = day - F.when(~is_leap(year) & (day > LEAP_DAY), 1).otherwise(0)
    rows = df.where(is_leap(year) | (day != LEAP_DAY))
    return rows.select(*keys, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), real - 1).alias("time"), "value")


def gregorian_length_as_366(n_days: int, start_year: int) -> int:
    """How many steps ``n_days`` real days from Jan 1 of ``start_year`` take in years of 366 days."""
    out, year = 0, start_year
    while n_days > 0:
        days = 366 if calendar.isleap(year) else 365
        took = min(days, n_days)
        out += took + (1 if days == 365 and took >= LEAP_DAY else 0)
        n_days, year = n_days - took, year + 1
    return out


def days_since(time: Column, origin: str = "1800-01-01") -> Column:
    return F.datediff(time, F.lit(origin).cast("date"))


def time_axis(spark, start: str, steps: int, periodicity: Periodicity = Periodicity.monthly) -> DataFrame:
    """(step, time, days_since_1800) of a regular axis."""
    step = F.col("id").cast("int")
    first = F.lit(start).cast("date")
    time = F.add_months(first, step) if periodicity is Periodicity.monthly else F.date_add(first, step)
    return spark.range(steps).select(step.alias("step"), time.alias("time")).withColumn("days_since_1800", days_since(F.col("time")))
