"""The data behind the usual plots, as tables that any plotting library can draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import eleven_class
from ..operators.runs import identify_events, monitor


def index_bars(df: DataFrame, value: str = "value") -> DataFrame:
    """Each step with its class and colour; steps without a value are left out."""
    v = F.col(value)
    return df.where(v.isNotNull()).withColumns({"class": eleven_class(v), "colour": eleven_class(v, colour=True)})


def event_spans(df: DataFrame, threshold: float = -1.0, min_duration: int = 1) -> DataFrame:
    """Begin, end and peak of every event."""
    return identify_events(df, threshold, min_duration).select("cell_id", "event_id", "start_date", "end_date", "peak_date", "peak")


def event_metric(events: DataFrame, metric: str = "duration") -> DataFrame:
    """One metric by event, and its mean over the series."""
    from pyspark.sql import Window

    mean = F.avg(metric).over(Window.partitionBy("cell_id"))
    return events.select("cell_id", "event_id", "start_date", F.col(metric).cast("double").alias("value"), mean.alias("mean"))


def event_timeline(df: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Monitoring values with null outside events."""
    rows = monitor(df, threshold)
    hide = {c: F.when(F.col("is_event"), F.col(c)) for c in ("duration", "magnitude_cumulative", "intensity", "peak_so_far")}
    return rows.withColumns(hide)


def map_of(stats: DataFrame, cells: DataFrame, variable: str) -> DataFrame:
    """(lat, lon, value) of a cell statistic."""
    return cells.select("cell_id", "lat", "lon").join(stats.select("cell_id", F.col(variable).alias("value")), "cell_id", "left").drop("cell_id")
