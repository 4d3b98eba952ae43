"""Enums, constants and patterns.  All numbers and names here are fixed values of the published methods."""

from __future__ import annotations

from enum import Enum


class Periodicity(Enum):
    """How many periods a calendar year has; daily years all count 366 days."""

    monthly = 12
    daily = 366

    def __str__(self) -> str:
        return self.name

    @classmethod
    def from_string(cls, text: str) -> Periodicity:
        try:
            return cls[text.lower()]
        except KeyError:
            raise ValueError(f"unknown periodicity {text!r}; one of {[p.name for p in cls]}") from None

    def unit(self) -> str:
        return {"monthly": "month", "daily": "day"}[self.name]


class Distribution(Enum):
    GAMMA = "gamma"
    PEARSON3 = "pearson3"
    LOG_LOGISTIC = "log_logistic"
    GEV = "gev"
    GEN_LOGISTIC = "gen_logistic"

    @classmethod
    def parse(cls, name: str | Distribution) -> Distribution:
        return name if isinstance(name, cls) else cls(str(name).lower().replace("-", "_"))


class Method(Enum):
    MOMENTS = "moments"
    LMOMENTS = "lmoments"
    MLE = "mle"

    @classmethod
    def parse(cls, name: str | Method) -> Method:
        return name if isinstance(name, cls) else cls(str(name).lower())


VALID_MIN, VALID_MAX = -3.09, 3.09
FILL_VALUE = -9999.0
MIN_GAMMA_VALUES = 4
CALIBRATION_START, CALIBRATION_END = 1991, 2020
WATER_BALANCE_OFFSET = 1000.0
PROB_LOW, PROB_HIGH = 1e-10, 1.0 - 1e-10

# distribution toolkit
MIN_VALUES, MIN_NONZERO, MAX_ZERO_SHARE = 30, 10, 0.95
EPS, MIN_VARIANCE = 1e-10, 1e-8
MAX_SHAPE, MIN_SCALE, MAX_SCALE = 1000.0, 1e-10, 1e10

#: Parameters of each family; the zero share comes with all of them.
PARAMS = {
    "gamma": ("alpha", "beta"),
    "pearson3": ("skew", "loc", "scale"),
    "log_logistic": ("alpha", "beta"),
    "gev": ("shape", "loc", "scale"),
    "gen_logistic": ("shape", "loc", "scale"),
}
DISPLAY = {
    "gamma": "Gamma",
    "pearson3": "Pearson III",
    "log_logistic": "Log-Logistic",
    "gev": "GEV",
    "gen_logistic": "Generalized Logistic",
}
DEFAULT_METHOD = {
    "gamma": Method.MOMENTS,
    "pearson3": Method.MOMENTS,
    "log_logistic": Method.MLE,
    "gev": Method.LMOMENTS,
    "gen_logistic": Method.LMOMENTS,
}
RECOMMENDED = {"spi": "gamma", "spei": "pearson3", "extreme": "gev"}

# substrings that name a variable's kind; users may extend the lists
PRECIP_PATTERNS = ["precip", "prcp", "precipitation", "pr", "ppt", "rainfall"]
PET_PATTERNS = ["pet", "eto", "et", "evap"]
TEMP_PATTERNS = ["temp", "tas", "tasmin", "tasmax", "t2m", "tmean", "tmin", "tmax"]

MEMORY_MULTIPLIER, MEMORY_SAFETY = 12.0, 0.7
CHUNK, MIN_CHUNK = 500, 100

#: Users may set their own before they write; empty entries are left out.
METADATA = {"institution": "", "source": "climext", "Conventions": "CF-1.8", "references": "", "comment": ""}
