"""Names and descriptive attributes of outputs; the names, patterns and wordings are fixed values that outputs carry."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import DISPLAY, METADATA, PARAMS, VALID_MAX, VALID_MIN, Periodicity

_INDEX = {
    "spi": "Standardized Precipitation Index",
    "spei": "Standardized Precipitation Evapotranspiration Index",
}


def variable_name(index: str, scale: int, periodicity: Periodicity = Periodicity.monthly, distribution: str = "gamma") -> str:
    return f"{index.lower()}_{distribution.lower()}_{scale}_{periodicity.unit()}"


def param_name(param: str, scale: int, periodicity: Periodicity = Periodicity.monthly, distribution: str = "gamma") -> str:
    valid = (*PARAMS.get(distribution.lower(), PARAMS["gamma"]), "prob_zero")
    if param not in valid:
        raise ValueError(f"{param!r} is no parameter of {distribution.lower()}; one of {valid}")
    return f"{param}_{scale}_{periodicity.unit()}"


def long_name(index: str, scale: int, periodicity: Periodicity = Periodicity.monthly, distribution: str = "gamma") -> str:
    family = DISPLAY.get(distribution.lower(), distribution)
    return f"{_INDEX.get(index.lower(), index.upper())} ({family}), {scale}-{periodicity.unit()}"


def variable_attributes(
    index: str, scale: int, periodicity: Periodicity = Periodicity.monthly, distribution: str = "gamma"
) -> dict:
    return {
        "long_name": long_name(index, scale, periodicity, distribution.lower()),
        "standard_name": variable_name(index, scale, periodicity, distribution),
        "units": "1",
        "valid_min": VALID_MIN,
        "valid_max": VALID_MAX,
        "distribution": distribution.lower(),
        "scale": scale,
        "periodicity": periodicity.name,
    }


_ROLES = {"alpha": "Shape", "beta": "Scale", "skew": "Skewness", "loc": "Location", "scale": "Scale", "shape": "Shape"}


def param_attributes(
    param: str, scale: int, periodicity: Periodicity = Periodicity.monthly, distribution: str = "gamma"
) -> dict:
    family, span = DISPLAY.get(distribution.lower(), distribution), f"{scale}-{periodicity.unit()}"
    if param == "prob_zero":
        text = f"Probability of zero values within calibration period for {span} scale"
    elif param in _ROLES:
        role = f"{_ROLES[param]} parameter" + (f" ({param})" if param in ("alpha", "beta") else "")
        text = f"{role} of the {family} distribution computed from {span} scaled values"
    else:
        text = f"{param} parameter"
    return {"long_name": f"{family} {param} parameter ({span})", "description": text, "units": "1"}


def global_attributes(
    title: str,
    distribution: str = "gamma",
    calibration_start: int | None = None,
    calibration_end: int | None = None,
    extra: dict | None = None,
    own: dict | None = None,
) -> dict:
    """Attributes of a whole output; what comes later wins: defaults, computed ones, ``extra``, the user's ``own``."""
    computed = {
        "title": title,
        "history": f"Created {datetime.now().isoformat()}",
        "distribution": distribution.lower(),
        "calibration_start_year": calibration_start,
        "calibration_end_year": calibration_end,
    }
    defaults = {k: v for k, v in METADATA.items() if v}
    return defaults | {k: v for k, v in computed.items() if v is not None} | (extra or {}) | (own or {})


def with_attributes(df: DataFrame, column: str, attributes: dict) -> DataFrame:
    """Attach attributes to a column; they survive Parquet."""
    return df.withColumn(column, F.col(column).alias(column, metadata=attributes))


def attributes_of(df: DataFrame, column: str) -> dict:
    return json.loads(json.dumps(df.schema[column].metadata))


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PB"
