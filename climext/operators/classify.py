"""Categories of index values, areas under threshold, comparisons of index columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds (inclusive), names and colours of the eleven classes.
ELEVEN = (
    (-2.0, "exceptionally_dry", "#760005"),
    (-1.5, "extremely_dry", "#ec0013"),
    (-1.2, "severely_dry", "#ffa938"),
    (-0.7, "moderately_dry", "#fdd28a"),
    (-0.5, "abnormally_dry", "#fefe53"),
    (0.5, "near_normal", "#ffffff"),
    (0.7, "abnormally_moist", "#a2fd6e"),
    (1.2, "moderately_moist", "#00b44a"),
    (1.5, "very_moist", "#008180"),
    (2.0, "extremely_moist", "#2a23eb"),
    (float("inf"), "exceptionally_moist", "#a21fec"),
)


def mckee_class(v: Column, scheme: str = "mckee") -> Column:
    """4 (extremely wet) to -2 (extremely dry); null for any other scheme."""
    if scheme != "mckee":
        return F.lit(None).cast("int")
    return (
        F.when(v >= 2.0, 4).when(v >= 1.5, 3).when(v >= 1.0, 2).when(v <= -2.0, -2).when(v <= -1.5, -1).when(v <= -1.0, 0).when(v.isNotNull(), 1)
    )


def eleven_class(v: Column, colour: bool = False) -> Column:
    """Name (or colour) of the value's class."""
    out = None
    for top, name, shade in ELEVEN:
        label = F.lit(shade if colour else name)
        test = v <= top
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def area_percentage(df: DataFrame, threshold: float = -1.0, value: str = "value", time: str = "time") -> DataFrame:
    """Percent of the cells with a value whose value is at or below the threshold, for each time."""
    n = F.count(value)
    return df.groupBy(time).agg(F.when(n > 0, F.count_if(F.col(value) <= threshold) * 100.0 / n).alias("area_percentage"))


def wet_area_percentage(df: DataFrame, threshold: float = 1.0, value: str = "value", time: str = "time") -> DataFrame:
    """Percent of all cells, missing ones too, whose value is at or above the threshold."""
    return df.groupBy(time).agg((F.count_if(F.col(value) >= threshold) * 100.0 / F.count("*")).alias("area_percentage"))


def compare_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation and differences of two index columns over the rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.abs(F.col(a) - F.col(b))
    return both.agg(
        F.count("*").alias("n"), F.corr(a, b).alias("correlation"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff")
    )


def regional_mean(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    return df.groupBy(time).agg(F.avg(value).alias("regional_mean"))
