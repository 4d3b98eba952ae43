"""The gridded cube as a long table (cell_id, time, value): adapters, missing values, calendar, tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FILL_VALUE, Periodicity


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN, infinities and the fill value become null; NaN compares as the largest number in Spark."""
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        out[c] = F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (v != FILL_VALUE), v)
    return df.withColumns(out)


def find_variable(columns: Sequence[str], patterns: Sequence[str], exactly_one: bool = True) -> str:
    """The column whose name holds one of ``patterns`` (any case).

    ``exactly_one``: several or none raise; otherwise the first match, or the first column.
    """
    found = [c for c in columns if any(p in c.lower() for p in patterns)]
    if not exactly_one:
        return (found or list(columns))[0]
    if len(found) != 1:
        raise ValueError(f"{'several columns match' if found else 'no column matches'} {list(patterns)}: {found or list(columns)}")
    return found[0]


def from_series(spark: SparkSession, values: Sequence[float | None], start: str = "2000-01-01", cell_id: int = 0) -> DataFrame:
    """One location's monthly values as (cell_id, time, value)."""
    rows = [(cell_id, i, None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell_id long, i int, value double").select(
        "cell_id", F.add_months(F.lit(start).cast("date"), F.col("i")).alias("time"), "value"
    )


def from_array(spark: SparkSession, cube, lats: Sequence[float], lons: Sequence[float], start: str = "2000-01-01") -> DataFrame:
    """A (time, lat, lon) array as (cell_id, lat, lon, time, value); for small inputs, large ones are read as tables."""
    rows = [
        (i * len(lons) + j, float(la), float(lo), t, None if cube[t][i][j] != cube[t][i][j] else float(cube[t][i][j]))
        for t in range(len(cube))
        for i, la in enumerate(lats)
        for j, lo in enumerate(lons)
    ]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double, i int, value double")
    return df.withColumn("time", F.add_months(F.lit(start).cast("date"), F.col("i"))).drop("i")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Usual coordinate names to lat, lon and time; raises if there is no time."""
    names = {"latitude": "lat", "y": "lat", "longitude": "lon", "x": "lon", "date": "time", "valid_time": "time"}
    out = df.withColumnsRenamed({c: names[c.lower()] for c in df.columns if c.lower() in names and names[c.lower()] not in df.columns})
    if "time" not in out.columns:
        raise ValueError(f"no time column among {df.columns}")
    return out


def year_range(df: DataFrame, time: str = "time") -> DataFrame:
    """(start_year, end_year) of the data."""
    return df.agg(F.min(F.year(time)).alias("start_year"), F.max(F.year(time)).alias("end_year"))


def has_valid(df: DataFrame, value: str = "value", keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """For each key, whether any value is there."""
    return df.groupBy(*keys).agg((F.count(value) > 0).alias("is_valid"))


def densify(
    df: DataFrame, start: str, end: str, value: str = "value", fill: float | None = None, cells: DataFrame | None = None, periodicity: Periodicity = Periodicity.monthly
) -> DataFrame:
    """A row for every cell and month (or day) from ``start`` to ``end``; window frames count rows, so none may lack.

    The steps are made cell by cell (``explode(sequence)``), so no cross join is needed.  Spark takes the exploded side to be
    as small as the cells and would send it whole to every task where a filter on the values makes the join an inner one;
    the hint sorts and merges instead.
    """
    cells = (df if cells is None else cells).select("cell_id").distinct()
    step = "MONTH" if periodicity is Periodicity.monthly else "DAY"
    steps = F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 {step})"))
    full = cells.select("cell_id", steps.alias("time")).hint("merge")
    out = full.join(df.withColumn("time", F.col("time").cast("date")), ["cell_id", "time"], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def period_of(time: Column, periodicity: Periodicity = Periodicity.monthly) -> Column:
    """Calendar period: the month, or the day of a year that always has a Feb 29."""
    if periodicity is Periodicity.monthly:
        return F.month(time)
    leap = F.dayofyear(F.make_date(F.year(time), F.lit(12), F.lit(31))) == 366
    return F.dayofyear(time) + F.when(~leap & (F.dayofyear(time) >= 60), 1).otherwise(0)


def zero_counts(df: DataFrame, value: str = "value", keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """(zeros, non_missing) for each key."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value) == 0).alias("zeros"), F.count(value).alias("non_missing"))


def completeness(df: DataFrame, value: str = "value", n_time: int | None = None) -> DataFrame:
    """One row: land and ocean cells, and how complete the land cells are (percent)."""
    cells = df.groupBy("cell_id").agg(F.count(value).alias("valid"), F.count("*").alias("steps"))
    steps = F.max("steps") if n_time is None else F.lit(n_time)
    share = F.when(F.col("valid") > 0, F.col("valid") * 100.0 / (F.col("steps") if n_time is None else F.lit(n_time)))
    total, land = F.count("*"), F.count_if(F.col("valid") > 0)
    full = F.count_if((F.col("valid") > 0) & (F.col("valid") == (F.col("steps") if n_time is None else F.lit(n_time))))
    return cells.agg(
        total.alias("total_cells"),
        land.alias("land_cells"),
        (total - land).alias("ocean_cells"),
        F.when(total > 0, land * 100.0 / total).otherwise(0.0).alias("land_fraction"),
        F.coalesce(steps, F.lit(0)).cast("long").alias("total_timesteps"),
        F.coalesce(F.avg(share), F.lit(0.0)).alias("mean_temporal_completeness"),
        F.coalesce(F.min(share), F.lit(0.0)).alias("min_temporal_completeness"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("max_temporal_completeness"),
        full.alias("fully_complete_land_cells"),
    )


def completeness_text(report: dict, indent: str = "   ") -> str:
    """The one-row report as text."""
    r = report
    return "\n".join(
        indent + line
        for line in (
            f"Cells: {r['total_cells']:,}",
            f"Land: {r['land_cells']:,} ({r['land_fraction']:.1f}%), ocean: {r['ocean_cells']:,}",
            f"Time steps: {r['total_timesteps']:,}",
            f"Completeness of land: mean {r['mean_temporal_completeness']:.1f}%, "
            f"{r['min_temporal_completeness']:.1f}-{r['max_temporal_completeness']:.1f}%",
            f"Fully complete: {r['fully_complete_land_cells']:,}",
        )
    )
