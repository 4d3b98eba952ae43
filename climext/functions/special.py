"""Special functions as Column expressions, and the incomplete gamma function as an Arrow function.

``gamma_p`` and :func:`standardize` are Arrow functions; everything else stays in generated JVM code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import PROB_HIGH, PROB_LOW, VALID_MAX, VALID_MIN
from ..session import ship

# Rational approximations of the normal quantile (Wichura 1988, PPND16), constant term first.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Stirling's series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _ratio(of, x):
    def horner(c):
        out = c[-1]
        for a in reversed(c[:-1]):
            out = out * x + a
        return out

    return horner(of[0]) / horner(of[1])


def norm_ppf(p: Column) -> Column:
    """Normal quantile of ``p`` in (0, 1), to 1e-15; null outside."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.when(tail <= 5, _ratio(_NEAR, tail - 1.6)).otherwise(_ratio(_FAR, tail - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * outer)
    return F.when((p > 0) & (p < 1), value)


def norm_ppf_sql(p: str) -> str:
    """The same quantile as SQL text."""

    def ratio(of, x):
        def horner(c):
            out = repr(c[-1])
            for a in reversed(c[:-1]):
                out = f"({out}*{x}+{a!r})"
            return out

        return f"({horner(of[0])}/{horner(of[1])})"

    q, tail = f"({p}-0.5)", f"sqrt(-ln(CASE WHEN {p}<0.5 THEN {p} ELSE 1-{p} END))"
    near, far = ratio(_NEAR, f"({tail}-1.6)"), ratio(_FAR, f"({tail}-5.0)")
    outer = f"sign({q})*CASE WHEN {tail}<=5 THEN {near} ELSE {far} END"
    return f"CASE WHEN abs({q})<=0.425 THEN {q}*{ratio(_CENTRE, f'(0.180625-{q}*{q})')} ELSE {outer} END"


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (``greatest`` would skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def to_standard_normal(p: Column) -> Column:
    """Probability to index value within +-3.09."""
    return clamp(norm_ppf(clamp(p, PROB_LOW, PROB_HIGH)), VALID_MIN, VALID_MAX)


def np_norm_ppf(p: np.ndarray) -> np.ndarray:
    """Normal quantile of probabilities in (0, 1)."""
    q = p - 0.5
    tail = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
    outer = np.sign(q) * np.where(tail <= 5, _ratio(_NEAR, tail - 1.6), _ratio(_FAR, tail - 5.0))
    return np.where(np.abs(q) <= 0.425, q * _ratio(_CENTRE, 0.180625 - q * q), outer)


@F.pandas_udf(DoubleType())
def _index_value(p: pd.Series) -> pd.Series:
    x = p.to_numpy(float)
    z = np.clip(np_norm_ppf(np.clip(np.where(np.isnan(x), 0.5, x), PROB_LOW, PROB_HIGH)), VALID_MIN, VALID_MAX)
    return pd.Series(z).astype("Float64").mask(np.isnan(x))


def standardize(df, probabilities: dict[str, Column]):
    """``df`` with an index column for each probability.

    The quantile is an Arrow function: as an expression its polynomials make code too long for the JVM to compile (ten
    times slower), and a filter on the result would be unfolded into thousands of copies of the probability.
    """
    ship()
    return df.withColumns({k: _index_value(p.cast("double")) for k, p in probabilities.items()})


def lgamma(x: Column) -> Column:
    """log Gamma of ``x`` > 0 (a plain column: it is used many times): shifted by 8, then Stirling's series."""
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    z = x + 8.0
    w, series = 1 / (z * z), F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * w + c
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - F.log(shift)


def gamma(x: Column) -> Column:
    return F.exp(lgamma(x))


def np_lgamma(x: np.ndarray) -> np.ndarray:
    shift = x.copy()
    for i in range(1, 8):
        shift *= x + i
    z = x + 8.0
    series, power = np.zeros_like(x), 1 / z
    for c in _STIRLING:
        series, power = series + c * power, power / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def np_digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 10.0
    w = 1 / (z * z)
    out = np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    for i in range(10):
        out = out - 1 / (x + i)
    return out


def np_gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a+1, continued fraction above, to convergence."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & (a > 0) & ~np.isnan(x)
    out[ok & (x <= 0)] = 0.0
    out[ok & np.isinf(x) & (x > 0)] = 1.0
    ok &= (x > 0) & np.isfinite(x)
    with np.errstate(all="ignore"):
        low = np.flatnonzero(ok & (x < a + 1))
        if len(low):
            aa, xx = a.flat[low], x.flat[low]
            term = np.ones(len(low))
            total, n, live = term.copy(), 0, np.arange(len(low))
            while len(live):
                n += 1
                term[live] *= xx[live] / (aa[live] + n)
                total[live] += term[live]
                live = live[term[live] > 1e-17 * total[live]]
            out.flat[low] = total * np.exp(aa * np.log(xx) - xx - np_lgamma(aa + 1))
        high = np.flatnonzero(ok & (x >= a + 1))
        if len(high):
            aa, xx = a.flat[high], x.flat[high]
            tiny = 1e-300
            b = xx + 1 - aa
            c, d = np.full(len(high), 1 / tiny), 1 / b
            h, n, live = d.copy(), 0, np.arange(len(high))
            while len(live):
                n += 1
                an = -n * (n - aa[live])
                b[live] += 2
                d[live] = an * d[live] + b[live]
                d[live] = 1 / np.where(np.abs(d[live]) < tiny, tiny, d[live])
                c[live] = b[live] + an / c[live]
                c[live] = np.where(np.abs(c[live]) < tiny, tiny, c[live])
                step = c[live] * d[live]
                h[live] *= step
                live = live[np.abs(step - 1) > 1e-16]
                if n > 100_000:
                    break
            out.flat[high] = 1 - h * np.exp(aa * np.log(xx) - xx - np_lgamma(aa))
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(DoubleType())
def _gamma_p(a: pd.Series, x: pd.Series) -> pd.Series:
    out = np_gamma_p(a.to_numpy(float), x.to_numpy(float))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function P(a, x); null for null input."""
    ship()
    return _gamma_p(a.cast("double"), x.cast("double"))


# Rational approximations of the error function and its complement (Cody 1969).
_ERF = (
    (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
    (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
_ERFC = (
    (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
     4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
_ERFC_FAR = (
    (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
     1.63153871373020978e-2),
    (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _cody(of, t):
    """The quotient of two polynomials, both with their last given term's power leading."""
    above, below = of
    top, bottom = t * above[-1], t
    for a, b in zip(above[:-2], below[:-1], strict=True):
        top, bottom = (top + a) * t, (bottom + b) * t
    return (top + above[-2]) / (bottom + below[-1])


def norm_cdf(z: Column) -> Column:
    """Normal probability, to 1e-15; ``z`` should be a plain column, as it is used many times."""
    x = z / math.sqrt(2)
    y = F.abs(x)
    t = F.try_divide(F.lit(1.0), y * y)
    far = F.try_divide(1 / math.sqrt(math.pi) - t * _cody(_ERFC_FAR, t), y)
    tail = F.exp(-y * y) * F.when(y <= 4, _cody(_ERFC, y)).otherwise(far) / 2
    return F.when(y <= 0.46875, 0.5 + x * _cody(_ERF, y * y) / 2).when(z < 0, tail).otherwise(1 - tail)


def norm_cdf_sql(z: str) -> str:
    """The same probability as SQL text."""
    x = f"({z}/{math.sqrt(2)!r})"

    def cody(of, t):
        above, below = of
        top, bottom = f"({t}*{above[-1]!r})", t
        for a, b in zip(above[:-2], below[:-1], strict=True):
            top, bottom = f"(({top}+{a!r})*{t})", f"(({bottom}+{b!r})*{t})"
        return f"(({top}+{above[-2]!r})/({bottom}+{below[-1]!r}))"

    y = f"abs({x})"
    t = f"(1/({y}*{y}))"
    far = f"(({1 / math.sqrt(math.pi)!r}-{t}*{cody(_ERFC_FAR, t)})/{y})"
    tail = f"(exp(-{y}*{y})*CASE WHEN {y}<=4 THEN {cody(_ERFC, y)} ELSE {far} END/2)"
    return f"CASE WHEN {y}<=0.46875 THEN 0.5+{x}*{cody(_ERF, f'({y}*{y})')}/2 WHEN {z}<0 THEN {tail} ELSE 1-{tail} END"
