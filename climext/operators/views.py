"""The driver's tables as cubes: suppliers are cells, months are steps, shipped quantities are amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grid import densify

START, END = "1995-01-01", "2001-12-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str, returned_only: bool = False, fill: float | None = None) -> DataFrame:
    """(cell_id, time, value, pet, tmean, tmin, tmax): months of every supplier, null (or ``fill``) where nothing was shipped."""
    lines = table(spark, sf_dir, "lineitem")
    if returned_only:
        lines = lines.where(F.col("l_returnflag") == "R")
    q = F.col("l_quantity")
    sums = lines.groupBy(F.col("l_suppkey").alias("cell_id"), F.trunc("l_shipdate", "MM").alias("time")).agg(
        F.sum(q).alias("value"),
        F.sum(F.round(q * F.col("l_discount"), 2) * 8).alias("pet"),
        (F.avg(q) - 10).alias("tmean"),
        (F.min(q) - 20).alias("tmin"),
        F.max(q).alias("tmax"),
    )
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"))
    out = densify(sums, START, END, "value", fill, cells)
    return out.withColumn("lat", ((F.col("cell_id") % 25) - 12) * 5.0)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, time, value): the z-score of each month within its supplier."""
    w = Window.partitionBy("cell_id")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    return monthly(spark, sf_dir).select("cell_id", "time", z.alias("value"))


def long_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, time, value, pet) of forty years: the order's number stands for the month, 0 where nothing was shipped."""
    q = F.col("l_quantity")
    month = F.add_months(F.lit("1960-01-01").cast("date"), (F.col("l_orderkey") % 480).cast("int"))
    sums = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("cell_id"), month.alias("time")).agg(
        F.sum(q).alias("value"), F.sum(F.round(q * F.col("l_discount"), 2) * 8).alias("pet")
    )
    out = densify(sums, "1960-01-01", "1999-12-01", "value", 0.0)
    return out.withColumn("pet", F.coalesce("pet", F.lit(0.0)))
