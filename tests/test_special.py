import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext.functions.special import lgamma, norm_cdf, norm_ppf, np_digamma, np_gamma_p
from climext.operators import fit


def test_incomplete_gamma_closed_forms():
    x = np.array([1e-8, 0.1, 1.0, 5.0, 40.0])
    assert np_gamma_p(np.ones(5), x) == pytest.approx(1 - np.exp(-x), abs=1e-14)
    assert np_gamma_p(np.full(5, 0.5), x) == pytest.approx([math.erf(math.sqrt(v)) for v in x], abs=1e-14)
    assert np.isnan(np_gamma_p(np.array([-1.0]), np.array([1.0])))[0]
    big = np_gamma_p(np.array([1e5, 1e5]), np.array([1e5 - 3 * 316.23, 1e5 + 3 * 316.23]))
    assert big == pytest.approx([0.00135, 0.99865], abs=2e-4)


def test_quantile_and_normal_probability(spark):
    ps = [1e-10, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps] + [(0.0,), (None,)], "p double").select("p", norm_ppf(F.col("p")).alias("z"))
    rows = df.withColumn("back", norm_cdf(F.col("z"))).collect()
    for r in rows[: len(ps)]:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-12)
        assert r["back"] == pytest.approx(r["p"], abs=1e-9)
    assert rows[-1]["z"] is None and rows[-2]["z"] is None


def test_lgamma_digamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 50.0, 900.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-11)
    assert float(np_digamma(1.0)) == pytest.approx(-0.5772156649015329, abs=1e-12)


def test_ks_pvalue_known_values():
    # P(D_1 < d) = 2d - 1 for d over a half; the limit law at x = 1.3581 leaves 0.05
    assert fit.np_ks_pvalue(0.8, 1) == pytest.approx(0.4, abs=1e-12)
    assert fit.np_ks_pvalue(1.3581 / (100 + 0.12 + 0.0011), 10_000) == pytest.approx(0.05, abs=1e-3)


def test_likelihood_recovers_parameters():
    rng = np.random.default_rng(3)
    y = rng.logistic(2.0, 0.4, 4000)
    mu, s = fit.np_logistic_mle(y)
    assert (mu, s) == (pytest.approx(2.0, abs=0.05), pytest.approx(0.4, abs=0.02))
    x = 10 - 3 * np.log(-np.log(rng.random(4000)))
    k, loc, scale = fit.np_nelder_mead(lambda p: fit._gev_loss(x, p), np.array([0.05, 9.0, 2.0]))
    assert (k, loc, scale) == (pytest.approx(0, abs=0.06), pytest.approx(10, abs=0.3), pytest.approx(3, abs=0.2))


def test_simplexes_side_by_side_equal_each_alone():
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.gamma(2.0, 30.0, (60, 83)), 300 + 40 * rng.standard_normal((60, 83)), rng.gumbel(50.0, 9.0, (60, 83))]), axis=1)
    x[7] = 5.0
    for family in ("pearson3", "gev"):
        together = fit.np_simplex_mle(x, family)
        alone = np.concatenate([fit.np_simplex_mle(row[None], family) for row in x])
        assert np.isnan(together[7]).all() and np.array_equal(together, alone, equal_nan=True)


def test_simplex_ends_where_no_step_changes_it():
    """Without a finite loss nothing but shrinking is left; it ran 2,000 steps of five losses each."""
    asked = []
    got = fit.np_nelder_mead(lambda p: asked.append(1) or math.inf, np.array([0.5, 300.0, 40.0]))
    assert got.tolist() == [0.5, 300.0, 40.0] and len(asked) < 1000


def test_likelihood_fits_as_one_stream(spark):
    """Samples over several Arrow batches, one longer than what is fitted at once, others without a fit; not one Python call each."""
    rng = np.random.default_rng(6)
    samples = {c: rng.gumbel(50.0 + c, 9.0, 30 + c % 5) for c in range(40)} | {100: rng.gumbel(20.0, 3.0, fit._TOGETHER + 900), 101: np.full(50, 2.0), 102: np.arange(5.0)}
    rows = [(c, float(v)) for c, values in samples.items() for v in values] + [(103, None), (0, float("nan")), (1, float("inf"))]
    df = spark.createDataFrame(rows, "cell_id long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        fitted = fit.fit(df, ["cell_id"], "v", "gev", "mle")
        assert "FlatMapGroupsInPandas" not in fitted._jdf.queryExecution().executedPlan().toString()
        got = {r["cell_id"]: (r["shape"], r["loc"], r["scale"]) for r in fitted.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(samples)
    for c, values in samples.items():
        want = fit.np_simplex_mle(np.sort(values)[None], "gev")[0]
        assert got[c] == ((None,) * 3 if np.isnan(want).any() else tuple(want.tolist()))


def test_norm_cdf(spark):
    import math

    from pyspark.sql import functions as F

    from climext.functions.special import norm_cdf

    z = [i / 7 for i in range(-70, 71)]
    for x, p in zip(z, [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").coalesce(1).select(norm_cdf(F.col("z"))).collect()], strict=True):
        assert abs(p / (0.5 * math.erfc(-x / math.sqrt(2))) - 1) < 1e-13
