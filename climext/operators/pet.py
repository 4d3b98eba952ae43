"""Potential evapotranspiration from temperature: Thornthwaite and Hargreaves.

Day length and radiation of each month depend on latitude and leap year only: they are made once for each distinct
latitude (24 rows each) and joined to the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOLAR_CONSTANT = 0.0820
_POLE = math.pi / 2


def _within(value: Column, low: float, high: float, what: str, result: Column) -> Column:
    """``result``; an error where ``value`` is out of range, null where it is null."""
    wrong = F.raise_error(F.concat(F.lit(f"{what} must be in [{low:g}, {high:g}], got "), value.cast("string")))
    return F.when(value.between(low, high), result).when(value.isNotNull(), wrong.cast("double"))


def solar_declination(day: Column) -> Column:
    """Radians; days of the year other than 1 to 366 are an error."""
    return _within(day, 1, 366, "day of the year", 0.409 * F.sin(day * (2 * math.pi / 365) - 1.39))


def sunset_hour_angle(lat_rad: Column, declination: Column) -> Column:
    """Radians; latitudes beyond the poles are an error."""
    return _within(lat_rad, -_POLE, _POLE, "latitude in radians", _hour_angle(lat_rad, declination))


def _hour_angle(lat_rad: Column, declination: Column) -> Column:
    c = -F.tan(lat_rad) * F.tan(declination)
    return F.acos(F.when(c < -1, -1.0).when(c > 1, 1.0).otherwise(c))


def daylight_hours(angle: Column) -> Column:
    return angle * (24 / math.pi)


def extraterrestrial_radiation(lat_rad: Column, day: Column) -> Column:
    """MJ a square metre and day (FAO-56)."""
    d = solar_declination(day)
    w = sunset_hour_angle(lat_rad, d)
    near = 1 + 0.033 * F.cos(day * (2 * math.pi / 365))
    ra = (24 * 60 / math.pi) * SOLAR_CONSTANT * near * (w * F.sin(lat_rad) * F.sin(d) + F.cos(lat_rad) * F.cos(d) * F.sin(w))
    return F.when(ra < 0, 0.0).otherwise(ra)


def _table(spark, latitudes: DataFrame, of) -> DataFrame:
    """(lat, leap, month, mean) over the days of each month, for each distinct latitude."""
    leap = F.explode(F.array(F.lit(False), F.lit(True)))
    year = F.when(F.col("leap"), 2000).otherwise(2001)
    # latitudes beyond the poles have no days, so their rows get null
    days = latitudes.where(F.abs("lat") <= 90).select("lat").distinct().select("lat", leap.alias("leap"))
    days = days.withColumn(
        "date", F.explode(F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))))
    )
    return days.groupBy("lat", "leap", F.month("date").alias("month")).agg(
        F.avg(of(F.radians("lat"), F.dayofyear("date"))).alias("mean")
    )


def monthly_daylight(latitudes: DataFrame) -> DataFrame:
    """(lat, leap, month, mean): mean daylight hours of each month."""
    return _table(latitudes.sparkSession, latitudes, lambda lat, day: daylight_hours(sunset_hour_angle(lat, solar_declination(day))))


def monthly_radiation(latitudes: DataFrame) -> DataFrame:
    """(lat, leap, month, mean): mean extraterrestrial radiation of each month."""
    return _table(latitudes.sparkSession, latitudes, extraterrestrial_radiation)


def _leap(time: str) -> Column:
    return F.day(F.last_day(F.make_date(F.year(time), F.lit(2), F.lit(1)))) == 29


def _with_month_mean(df: DataFrame, table: DataFrame, latitude: str, time: str, out: str) -> DataFrame:
    """Join on latitude, leap year and month; Spark picks the join by the table's size (24 rows for each latitude)."""
    key = {"__lat": F.col(latitude), "__leap": _leap(time), "__month": F.month(time)}
    table = table.select(
        F.col("lat").alias("__lat"), F.col("leap").alias("__leap"), F.col("month").alias("__month"), F.col("mean").alias(out)
    )
    return df.withColumns(key).join(table, list(key), "left").drop(*key)


def thornthwaite(
    df: DataFrame, temperature: str = "tmean", latitude: str = "lat", out: str = "pet", cell: str = "cell_id", time: str = "time"
) -> DataFrame:
    """Monthly evapotranspiration; months below 0 degrees count as 0.

    The heat index is that of the whole record: means of each calendar month, then their sum, as windows over the cell.
    """
    t = F.when(F.col(temperature) < 0, 0.0).otherwise(F.col(temperature))
    rows = _with_month_mean(df, monthly_daylight(df.select(F.col(latitude).alias("lat"))), latitude, time, "__light")
    rows = rows.withColumns({"__t": t, "__m": F.month(time)})
    by_month, by_cell = Window.partitionBy(cell, "__m"), Window.partitionBy(cell)
    # each month's share of the heat index, spread over its rows
    rows = rows.withColumn("__part", F.pow(F.avg("__t").over(by_month) / 5.0, F.lit(1.514)) / F.count("*").over(by_month))
    rows = rows.withColumn("__heat", F.sum("__part").over(by_cell))
    i = F.col("__heat")
    a = 6.75e-07 * i * i * i - 7.71e-05 * i * i + 1.792e-02 * i + 0.49239
    days = F.day(F.last_day(time))
    pet = 16.0 * (F.col("__light") / 12.0) * (days / 30.0) * F.pow(F.try_divide(10.0 * F.col("__t"), i), a)
    ok = (F.col(latitude) > -90) & (F.col(latitude) < 90)
    return rows.withColumn(out, F.when(ok & (i == 0), 0.0).when(ok, pet)).drop("__light", "__t", "__m", "__part", "__heat")


def hargreaves(
    df: DataFrame,
    tmean: str = "tmean",
    tmin: str = "tmin",
    tmax: str = "tmax",
    latitude: str = "lat",
    out: str = "pet",
    time: str = "time",
) -> DataFrame:
    rows = _with_month_mean(df, monthly_radiation(df.select(F.col(latitude).alias("lat"))), latitude, time, "__ra")
    spread = F.col(tmax) - F.col(tmin)
    spread = F.when(spread < 0, 0.0).otherwise(spread)
    pet = 0.0023 * F.col("__ra") * 0.408 * (F.col(tmean) + 17.8) * F.sqrt(spread) * F.day(F.last_day(time))
    ok = (F.col(latitude) > -90) & (F.col(latitude) < 90)
    return rows.withColumn(out, F.when(ok, F.when(pet < 0, 0.0).otherwise(pet))).drop("__ra")


def potential_evapotranspiration(
    df: DataFrame,
    temperature: str,
    latitude: str,
    method: str = "thornthwaite",
    temp_min: str | None = None,
    temp_max: str | None = None,
    out: str = "pet",
    cell: str = "cell_id",
    time: str = "time",
) -> DataFrame:
    if method == "thornthwaite":
        return thornthwaite(df, temperature, latitude, out, cell, time)
    if method == "hargreaves":
        if temp_min is None or temp_max is None:
            raise ValueError("hargreaves needs temp_min and temp_max")
        return hargreaves(df, temperature, temp_min, temp_max, latitude, out, time)
    raise ValueError(f"unknown method {method!r}; thornthwaite or hargreaves")
