"""Standardized indices: rolling accumulation, fit for each cell and calendar period, normal scores.

The gamma path shuffles once: the rolling frame, the fit (a window over cell and period, so nothing is joined
back) and the scores all run on data dealt by cell.  Several scales share those windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALIBRATION_END, CALIBRATION_START, MIN_GAMMA_VALUES, WATER_BALANCE_OFFSET, Distribution, Periodicity
from ..functions.special import gamma_p, standardize
from ..naming import variable_attributes, variable_name, with_attributes
from . import fit
from .grid import period_of
from .pet import potential_evapotranspiration


def rolling_sum(
    df: DataFrame, scale: int, value: str = "value", out: str = "scaled", keys: Sequence[str] = ("cell_id",), order: str = "time"
) -> DataFrame:
    """Trailing sum of ``scale`` steps; null unless all of them are there.  Rows must be dense in time."""
    return df.withColumn(out, _rolling(F.col(value), scale, Window.partitionBy(*keys).orderBy(order)))


def _rolling(v: Column, scale: int, w) -> Column:
    if scale < 1:
        raise ValueError(f"scale must be 1 or more, got {scale}")
    if scale == 1:
        return v
    frame = w.rowsBetween(1 - scale, 0)
    return F.when(F.count(v).over(frame) == scale, F.sum(v).over(frame))


def water_balance(precip: Column, pet: Column) -> Column:
    return precip - pet + WATER_BALANCE_OFFSET


def not_negative(v: Column) -> Column:
    return F.when(v < 0, 0.0).otherwise(v)


def in_calibration(time: str, start: int | None, end: int | None) -> Column:
    """Whether a row is in the calibration years; a window outside the data calibrates nothing (null indices)."""
    year, out = F.year(time), F.lit(True)
    if start is not None:
        out &= year >= start
    if end is not None:
        out &= year <= end
    return out


_PARTS = ("n", "zeros", "some", "mean", "a")


def thom_parts(v: Column, calibrated: Column, over=lambda c: c) -> dict[str, Column]:
    """What the log-mean estimator needs, as aggregates (``over`` may put them in a window)."""
    x = F.when(calibrated, v)
    positive = F.when(x > 0, x)
    return {
        "n": over(F.count(x)),
        "zeros": over(F.count_if(x == 0)),
        "some": over(F.count(positive)),
        "mean": over(F.avg(positive)),
        "a": F.log(over(F.avg(positive))) - over(F.avg(F.log(positive))),
    }


def thom_of(part: dict[str, Column]) -> dict[str, Column]:
    """alpha, beta, prob_zero of those parts."""
    a = part["a"]
    alpha = F.when((part["some"] >= MIN_GAMMA_VALUES) & (a > 0), F.try_divide(1 + F.sqrt(1 + 4 * a / 3), 4 * a))
    return {"alpha": alpha, "beta": F.try_divide(part["mean"], alpha), "prob_zero": F.try_divide(part["zeros"], part["n"])}


def thom_gamma(rows: DataFrame, keys: Sequence[str], v: Column, calibrated: Column) -> DataFrame:
    """(keys, alpha, beta, prob_zero) by the log-mean estimator."""
    parts = rows.groupBy(*keys).agg(*(c.alias(f"__{k}") for k, c in thom_parts(v, calibrated).items()))
    made = thom_of({k: F.col(f"__{k}") for k in _PARTS})
    return parts.select(*keys, *(c.alias(k) for k, c in made.items()))


def gamma_params(
    df: DataFrame,
    value: str = "scaled",
    time: str = "time",
    start: int | None = CALIBRATION_START,
    end: int | None = CALIBRATION_END,
    periodicity: Periodicity = Periodicity.monthly,
    keys: Sequence[str] = ("cell_id",),
) -> DataFrame:
    """(keys, period, alpha, beta, prob_zero) of the index pipeline."""
    rows = df.withColumn("period", period_of(F.col(time), periodicity))
    return thom_gamma(rows, [*keys, "period"], F.col(value), in_calibration(time, start, end))


def with_zero_share(
    params: DataFrame,
    df: DataFrame,
    value: str = "scaled",
    time: str = "time",
    start: int | None = CALIBRATION_START,
    end: int | None = CALIBRATION_END,
    periodicity: Periodicity = Periodicity.monthly,
    keys: Sequence[str] = ("cell_id",),
) -> DataFrame:
    """Given alpha and beta (keys, period, ...), the same with the share of zeros in the calibration years as ``prob_zero``."""
    x = F.when(in_calibration(time, start, end), F.col(value))
    rows = df.select(*keys, period_of(F.col(time), periodicity).alias("period"), x.alias("__x"))
    share = rows.groupBy(*keys, "period").agg(F.try_divide(F.count_if(F.col("__x") == 0), F.count("__x")).alias("prob_zero"))
    return params.drop("prob_zero").join(share, [*keys, "period"], "left")


def gamma_probability(v: Column, alpha: Column, beta: Column, prob_zero: Column) -> Column:
    """Probability of a scaled amount under fitted gamma parameters, zeros mixed in."""
    ok = (alpha > 0) & (beta > 0)
    p = F.when(v > 0, gamma_p(alpha, F.try_divide(v, beta))).when(v <= 0, 0.0)
    return F.when(ok & v.isNotNull(), prob_zero + (1 - prob_zero) * p)


def standardized_index(
    df: DataFrame,
    value: str,
    scales: Sequence[int],
    index: str,
    distribution: str = "gamma",
    periodicity: Periodicity = Periodicity.monthly,
    start: int | None = CALIBRATION_START,
    end: int | None = CALIBRATION_END,
    params: DataFrame | None = None,
    keep_params: bool = False,
    time: str = "time",
    cell: str = "cell_id",
) -> DataFrame:
    """``df`` with one index column for each scale, named as :func:`variable_name` says.

    ``params``: a saved table (see :func:`fit_index_params`) instead of a fit.  ``keep_params`` adds the
    parameters as ``<param>_<scale>_<unit>`` columns.
    """
    family = Distribution.parse(distribution).value
    by_time = Window.partitionBy(cell).orderBy(time)
    period = "__period"
    out = df.withColumns({f"__s{s}": _rolling(F.col(value), s, by_time) for s in scales})
    out = out.withColumn(period, period_of(F.col(time), periodicity))
    calibrated = in_calibration(time, start, end)
    results, drop = {}, [period, *(f"__s{s}" for s in scales)]
    likelihood = family != "gamma" and fit.DEFAULT_METHOD[family] is fit.Method.MLE
    names = (*fit.PARAMS[family], "prob_zero")
    table = params
    if params is None and likelihood:  # all scales in one fit
        table = fit_index_params(df, value, scales, family, periodicity, start, end, time, cell)
    if table is not None:  # one row for each cell and period, so that all scales take one join
        table = table.groupBy(cell, F.col("period").alias(period)).agg(
            *(F.max(F.when(F.col("scale_steps") == s, F.col(n))).alias(f"__{n}_{s}") for s in scales for n in names)
        )
        out = out.join(table, [cell, period], "left")
    for s in scales:
        v, made = F.col(f"__s{s}"), {}
        if table is not None:
            made = {n: F.col(f"__{n}_{s}") for n in names}
            drop += [f"__{n}_{s}" for n in names]
        elif family == "gamma":
            w = Window.partitionBy(cell, period)
            # the log-mean difference first: the estimator uses it many times
            parts = thom_parts(v, calibrated, lambda c, w=w: c.over(w))
            out = out.withColumns({f"__{n}_{s}": c for n, c in parts.items()})
            made = thom_of({n: F.col(f"__{n}_{s}") for n in _PARTS})
            drop += [f"__{n}_{s}" for n in _PARTS]
        else:
            out = fit.with_params(out, [cell, period], F.when(calibrated, v), [family], prefix=f"__{s}_")
            made = {n: F.col(f"__{s}_{family}_{n}") for n in names}
            drop += [f"__{s}_n", *(f"__{s}_{family}_{n}" for n in names)]
        held = {f"__p_{n}_{s}": c for n, c in made.items()}
        out = out.withColumns(held)
        drop += [k for k in held if not keep_params]
        got = {n: F.col(f"__p_{n}_{s}") for n in made}
        if family == "gamma":
            h = gamma_probability(v, **got)
        else:
            h = fit.cdf(v, family, got | {"prob_zero": F.coalesce(got["prob_zero"], F.lit(0.0))})
        results[variable_name(index, s, periodicity, family)] = h
    out = standardize(out, results).drop(*drop)
    for s in scales:
        out = with_attributes(out, variable_name(index, s, periodicity, family), variable_attributes(index, s, periodicity, family))
        if keep_params:
            names = {f"__p_{n}_{s}": f"{n}_{s}_{periodicity.unit()}" for n in (*fit.PARAMS[family], "prob_zero")}
            out = out.withColumnsRenamed(names)
    return out


def fit_index_params(
    df: DataFrame,
    value: str,
    scales: Sequence[int],
    distribution: str = "gamma",
    periodicity: Periodicity = Periodicity.monthly,
    start: int | None = CALIBRATION_START,
    end: int | None = CALIBRATION_END,
    time: str = "time",
    cell: str = "cell_id",
) -> DataFrame:
    """The params table (cell, period, scale_steps, distribution, parameters, prob_zero) of all scales in one pass."""
    family = Distribution.parse(distribution).value
    by_time = Window.partitionBy(cell).orderBy(time)
    scaled = df.withColumns({f"__s{s}": _rolling(F.col(value), s, by_time) for s in scales})
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("scale_steps"), F.col(f"__s{s}").alias("v")) for s in scales)))
    rows = scaled.select(cell, time, period_of(F.col(time), periodicity).alias("period"), pairs.alias("x")).select(
        cell, time, "period", "x.scale_steps", "x.v"
    )
    keys = [cell, "period", "scale_steps"]
    calibrated = in_calibration(time, start, end)
    if family == "gamma":
        table = thom_gamma(rows, keys, F.col("v"), calibrated)
    else:
        table = fit.fit(rows.where(calibrated), keys, "v", family).select(*keys, *fit.PARAMS[family], "prob_zero")
    return table.withColumn("distribution", F.lit(family))


def spi(df: DataFrame, scale: int | Sequence[int] = 12, value: str = "value", **how) -> DataFrame:
    """Standardized precipitation index of one scale or several; negative amounts count as 0."""
    scales = [scale] if isinstance(scale, int) else list(scale)
    out = standardized_index(df.withColumn("__amount", not_negative(F.col(value))), "__amount", scales, "spi", **how)
    return out.drop("__amount")


def spei(
    df: DataFrame,
    scale: int | Sequence[int] = 12,
    precip: str = "precip",
    pet: str | DataFrame | None = None,
    temperature: str | None = None,
    latitude: str | None = None,
    pet_method: str = "thornthwaite",
    temp_min: str | None = None,
    temp_max: str | None = None,
    validate: bool = False,
    cell: str = "cell_id",
    time: str = "time",
    **how,
) -> DataFrame:
    """Standardized precipitation-evapotranspiration index.

    ``pet``: a column of ``df``, or a table (cell, time, pet) joined on its keys; else it is computed once for all
    scales from ``temperature`` and ``latitude`` columns.  ``validate`` raises if the tables don't match row by row.
    """
    scales = [scale] if isinstance(scale, int) else list(scale)
    added = []
    if isinstance(pet, DataFrame):
        if validate:
            check_alignment(df, pet, [cell, time])
        name = next(c for c in pet.columns if c not in (cell, time))
        df = df.join(pet.select(cell, time, F.col(name).alias("__pet")), [cell, time])
        pet, added = "__pet", ["__pet"]
    elif pet is None:
        if temperature is None:
            raise ValueError("either pet or temperature is needed")
        if latitude is None:
            raise ValueError("temperature needs latitude")
        df = potential_evapotranspiration(df, temperature, latitude, pet_method, temp_min, temp_max, out="__pet", cell=cell, time=time)
        pet, added = "__pet", ["__pet"]
    out = df.withColumn("__balance", water_balance(F.col(precip), F.col(pet)))
    return standardized_index(out, "__balance", scales, "spei", cell=cell, time=time, **how).drop("__balance", *added)


def check_alignment(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Raise unless both tables have the same keys, each once."""
    n, m, both = a.count(), b.count(), a.select(*keys).join(b.select(*keys), list(keys)).count()
    if not n == m == both:
        raise ValueError(f"tables don't match: {n} and {m} rows, {both} in common")


def transform_with_params(df: DataFrame, params: DataFrame, value: str, distribution: str = "gamma", out: str = "index") -> DataFrame:
    """Index of already scaled values under a params table (cell_id, period, ...); for re-scoring new data."""
    family = Distribution.parse(distribution).value
    names = (*fit.PARAMS[family], "prob_zero")
    table = params.select("cell_id", "period", *(F.col(n).alias(f"__{n}") for n in names))
    rows = df.withColumn("period", period_of(F.col("time"))).join(table, ["cell_id", "period"], "left")
    got = {n: F.col(f"__{n}") for n in names}
    h = gamma_probability(F.col(value), **got) if family == "gamma" else fit.cdf(F.col(value), family, got)
    return standardize(rows, {out: h}).drop("period", *(f"__{n}" for n in names))


__all__ = ["fit_index_params", "gamma_params", "rolling_sum", "spei", "spi", "standardized_index", "thom_gamma"]
