"""Run theory: dry and wet events, monitoring, statistics for cells, years and periods.

The island number (steps outside the condition so far) and all other windows share one partitioning and order,
so a cell's series is shuffled and sorted once; grouping by cell and island needs no further exchange.
A negative threshold looks for values below it, any other for values above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


def _meets(v: Column, threshold: float, below: bool) -> Column:
    return F.coalesce(v < threshold if below else v > threshold, F.lit(False))


def _flagged(df: DataFrame, threshold: float, below: bool, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """keys, time, v, idx (from 0), hit, island (null outside runs)."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(*keys, C(time).alias("time"), C(value).cast("double").alias("v"))
    rows = rows.withColumn("hit", _meets(C("v"), threshold, below))
    outside = F.count_if(~C("hit")).over(w.rowsBetween(*UP_TO_NOW))
    return rows.withColumns({"idx": F.row_number().over(w) - 1, "island": F.when(C("hit"), outside)})


def runs(
    df: DataFrame, threshold: float = -1.0, below: bool = True, keys: Sequence[str] = ("cell_id",), value: str = "value", time: str = "time"
) -> DataFrame:
    """One row for each run of consecutive steps beyond the threshold; missing values break a run."""
    rows = _flagged(df, threshold, below, keys, value, time).where("hit")
    # the first index wins among equal peaks
    peak = F.min(F.struct("v", "idx", "time")) if below else F.max(F.struct("v", (-C("idx")).alias("idx"), "time"))
    return (
        rows.groupBy(*keys, "island")
        .agg(
            F.min("idx").alias("start_idx"),
            F.max("idx").alias("end_idx"),
            F.min("time").alias("start_date"),
            F.max("time").alias("end_date"),
            F.count("*").alias("duration"),
            F.sum(F.abs(C("v") - threshold)).alias("magnitude"),
            peak.alias("p"),
        )
        .select(
            *keys,
            "start_idx",
            "end_idx",
            "start_date",
            "end_date",
            "duration",
            "magnitude",
            (C("magnitude") / C("duration")).alias("intensity"),
            C("p.v").alias("peak"),
            F.abs("p.idx").alias("peak_idx"),
            C("p.time").alias("peak_date"),
        )
    )


def interarrival(events: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Steps from each event's start to the next one's; null on the last."""
    w = Window.partitionBy(*keys).orderBy("start_idx")
    return events.withColumn("interarrival", F.lead("start_idx").over(w) - C("start_idx"))


EVENT_COLUMNS = (
    "event_id", "start_idx", "end_idx", "start_date", "end_date", "duration", "magnitude", "intensity", "peak", "peak_idx",
    "peak_date", "interarrival",
)


def identify_events(
    df: DataFrame, threshold: float = -1.0, min_duration: int = 1, keys: Sequence[str] = ("cell_id",), value: str = "value", time: str = "time"
) -> DataFrame:
    """Runs of at least ``min_duration`` steps, numbered from 1 in each series, with the time to the next one."""
    found = runs(df, threshold, threshold < 0, keys, value, time).where(C("duration") >= min_duration)
    w = Window.partitionBy(*keys).orderBy("start_idx")
    return interarrival(found.withColumn("event_id", F.row_number().over(w)), keys).select(*keys, *EVENT_COLUMNS)


def monitor(
    df: DataFrame, threshold: float = -1.0, keys: Sequence[str] = ("cell_id",), value: str = "value", time: str = "time"
) -> DataFrame:
    """Running state of events at every step.

    ``event_id`` starts from 1 after each missing value and, once an event has occurred, grows by one with every step
    outside events; ``run_seq`` numbers the events of a series consecutively.
    """
    below = threshold < 0
    rows = _flagged(df, threshold, below, keys, value, time)
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(*UP_TO_NOW)
    segment = F.count_if(C("v").isNull()).over(w)
    rows = rows.withColumn("segment", segment)
    seg = Window.partitionBy(*keys, "segment").orderBy("time").rowsBetween(*UP_TO_NOW)
    started = F.max("hit").over(seg)
    rows = rows.withColumn("idle", F.when(started & ~C("hit") & C("v").isNotNull(), 1).otherwise(0))
    rows = rows.withColumn("ids", 1 + F.sum("idle").over(seg))
    run = Window.partitionBy(*keys, "island").orderBy("time").rowsBetween(*UP_TO_NOW)
    hit, off = C("hit"), F.abs(C("v") - threshold)
    rows = rows.withColumns({"d": F.count("*").over(run), "m": F.sum(off).over(run), "pk": (F.min if below else F.max)("v").over(run)})
    fresh = F.when(hit & (C("d") == 1), 1).otherwise(0)
    zero = lambda c: F.when(hit, c).otherwise(0)
    return rows.select(
        *keys,
        "time",
        C("v").alias("index_value"),
        hit.alias("is_event"),
        zero(C("ids")).cast("long").alias("event_id"),
        zero(C("d")).cast("long").alias("duration"),
        zero(C("m")).cast("double").alias("magnitude_cumulative"),
        zero(off).cast("double").alias("magnitude_instantaneous"),
        zero(C("m") / C("d")).cast("double").alias("intensity"),
        zero(C("pk")).cast("double").alias("peak_so_far"),
        zero(off).cast("double").alias("deviation"),
        F.when(hit, F.sum(fresh).over(w)).alias("run_seq"),
    )


def event_state(v: Column, threshold: float = -1.0) -> Column:
    """struct(is_event, category, deviation) of one value."""
    off = F.abs(v - threshold)
    if threshold < 0:
        name = F.when(v >= threshold, "No Event").when(v >= -1.5, "Moderate Drought").when(v >= -2.0, "Severe Drought").otherwise("Extreme Drought")
        hit = v < threshold
    else:
        name = F.when(v <= threshold, "No Event").when(v <= 1.5, "Moderately Wet").when(v <= 2.0, "Very Wet").otherwise("Extremely Wet")
        hit = v > threshold
    return F.struct(
        F.coalesce(hit, F.lit(False)).alias("is_event"),
        F.when(v.isNull(), "No Data").otherwise(name).alias("category"),
        F.when(hit, off).otherwise(0.0).alias("deviation"),
    )


def _by_cell(df: DataFrame, threshold: float, min_duration: int, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """Runs of every series, and one row (null island) for its other steps, so that no series is lost.

    Adds ``ok`` (a run that counts), and its duration, magnitude, intensity, peak.
    """
    below = threshold < 0
    rows = _flagged(df, threshold, below, keys, value, time)
    out = rows.groupBy(*keys, "island").agg(
        F.count("*").alias("steps"), F.sum(F.abs(C("v") - threshold)).alias("mag"), (F.min if below else F.max)("v").alias("pk")
    )
    ok = C("island").isNotNull() & (C("steps") >= min_duration)
    return out.select(
        *keys,
        "steps",
        ok.alias("ok"),
        F.when(ok, C("steps")).alias("duration"),
        F.when(ok, C("mag")).alias("magnitude"),
        F.when(ok, C("mag") / C("steps")).alias("intensity"),
        F.when(ok, C("pk")).alias("peak"),
    )


def spatial_events(
    df: DataFrame, threshold: float = -1.0, min_duration: int = 1, keys: Sequence[str] = ("cell_id",), value: str = "value", time: str = "time"
) -> DataFrame:
    """Event statistics of every cell; cells without events have num_events 0 and nulls."""
    e = _by_cell(df, threshold, min_duration, keys, value, time)
    extreme = F.min("peak") if threshold < 0 else F.max("peak")
    return e.groupBy(*keys).agg(
        F.count_if("ok").alias("num_events"),
        F.avg("duration").alias("mean_duration"),
        F.max("duration").alias("max_duration"),
        F.avg("magnitude").alias("mean_magnitude"),
        F.max("magnitude").alias("max_magnitude"),
        F.avg("intensity").alias("mean_intensity"),
        F.max("intensity").alias("max_intensity"),
        F.avg("peak").alias("mean_peak"),
        F.min("peak").alias("min_peak"),
        extreme.alias("extreme_peak"),
    )


def period_statistics(
    df: DataFrame,
    threshold: float = -1.0,
    start_year: int | None = None,
    end_year: int | None = None,
    min_duration: int = 1,
    keys: Sequence[str] = ("cell_id",),
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Event statistics of every cell within a window of years, which cuts runs at its edges."""
    if start_year is not None:
        df = df.where(F.year(time) >= start_year)
    if end_year is not None:
        df = df.where(F.year(time) <= end_year)
    e = _by_cell(df, threshold, min_duration, keys, value, time)
    months = F.coalesce(F.sum("duration"), F.lit(0))
    extreme = F.min("peak") if threshold < 0 else F.max("peak")
    return e.groupBy(*keys).agg(
        F.count_if("ok").alias("num_events"),
        months.alias("total_event_months"),
        F.coalesce(F.sum("magnitude"), F.lit(0.0)).alias("total_magnitude"),
        F.avg("magnitude").alias("mean_magnitude"),
        F.max("magnitude").alias("max_magnitude"),
        F.min("peak").alias("worst_peak"),
        F.avg("intensity").alias("mean_intensity"),
        F.max("intensity").alias("max_intensity"),
        (months / F.sum("steps") * 100).alias("pct_time_in_event"),
        extreme.alias("extreme_peak"),
    )


def annual_statistics(
    df: DataFrame, threshold: float = -1.0, min_duration: int = 1, keys: Sequence[str] = ("cell_id",), value: str = "value", time: str = "time"
) -> DataFrame:
    """Period statistics of every year in one pass: the year is part of the run's key."""
    return period_statistics(
        df.withColumn("year", F.year(time)), threshold, None, None, min_duration, [*keys, "year"], value, time
    )


def compare_periods(
    df: DataFrame,
    periods: Sequence[tuple[int, int]],
    threshold: float = -1.0,
    min_duration: int = 1,
    names: Sequence[str] | None = None,
    keys: Sequence[str] = ("cell_id",),
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Period statistics of several windows of years (they may overlap) in one pass, by ``period``."""
    names = [f"{a}-{b}" for a, b in periods] if names is None else list(names)
    if len(names) != len(periods):
        raise ValueError(f"{len(periods)} periods but {len(names)} names")
    all_ = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in zip(names, periods, strict=True)))
    mine = F.filter(all_, lambda p: F.year(time).between(p["a"], p["b"]))
    rows = df.withColumn("__p", F.explode(mine)).withColumn("period", C("__p.name")).drop("__p")
    return period_statistics(rows, threshold, None, None, min_duration, [*keys, "period"], value, time)


def period_difference(stats: DataFrame, later: str, earlier: str, variable: str, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``variable`` of one period less that of another, for each cell."""
    pick = lambda p: F.max(F.when(C("period") == p, C(variable)))
    return stats.groupBy(*keys).agg((pick(later) - pick(earlier)).alias(f"{variable}_change"))


def summarize_events(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summary of an event table, for all series or by ``keys``."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("num_events"),
        F.avg("duration").alias("mean_duration"),
        F.median("duration").alias("median_duration"),
        F.max("duration").alias("max_duration"),
        F.sum("duration").alias("total_event_months"),
        F.avg("magnitude").alias("mean_magnitude"),
        F.max("magnitude").alias("max_magnitude"),
        F.avg("intensity").alias("mean_intensity"),
        F.max("intensity").alias("max_intensity"),
        F.avg("peak").alias("mean_peak"),
        F.min("peak").alias("most_severe_peak"),
        F.avg("interarrival").alias("mean_interarrival"),
    )
