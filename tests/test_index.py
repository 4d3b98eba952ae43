import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import climext
from climext import densify, from_series, rolling_sum, spei, spi
from climext.config import Periodicity
from climext.naming import attributes_of, global_attributes, param_name, variable_name
from climext.operators import fit
from climext.operators.calendar import gregorian_length_as_366, to_366, to_gregorian
from climext.operators.grid import completeness, find_variable, missing_to_null
from climext.operators.index import fit_index_params, gamma_params
from climext.operators.pet import hargreaves, thornthwaite
from climext.plans.planning import estimate_memory, optimal_chunk, tile_table, tiles
from climext.sources.io import load_params, read_grid, save_index, save_params, spi_path


@pytest.fixture(scope="module")
def rain(spark):
    x = np.random.default_rng(1).gamma(2.0, 30.0, 480)
    return from_series(spark, x.tolist(), "1981-01-01").cache()


def test_rolling_needs_all_values(spark):
    got = rolling_sum(from_series(spark, [1.0, 2, 3, None, 5, 6, 7]), 3).orderBy("time").collect()
    assert [r.scaled for r in got] == [None, None, 6.0, None, None, None, 18.0]
    with pytest.raises(ValueError):
        rolling_sum(from_series(spark, [1.0]), 0)


@pytest.mark.parametrize("values,q,ok", [([0.0, 1, 2, 3, 4], 0.2, True), ([0.0, 0, 1, 2, 3], 0.4, False)])
def test_gamma_params(spark, values, q, ok):
    df = spark.createDataFrame([(0, y, float(v)) for y, v in zip(range(1995, 2000), values, strict=True)], "cell_id int, y int, scaled double")
    got = gamma_params(df.withColumn("time", F.make_date("y", F.lit(1), F.lit(1)))).first()
    assert got.prob_zero == q
    if ok:
        a = math.log(2.5) - math.log(24) / 4
        assert got.alpha == pytest.approx((1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)) and got.beta == pytest.approx(2.5 / got.alpha)
    else:
        assert got.alpha is None


def test_spi_is_standard_scale_free_and_idempotent(spark, rain, tmp_path):
    out = spi(rain, 3)
    cal = out.where("year(time) between 1991 and 2020").agg(F.avg("spi_gamma_3_month").alias("m"), F.stddev("spi_gamma_3_month").alias("s")).first()
    assert abs(cal.m) < 0.05 and abs(cal.s - 1) < 0.07
    other = spi(rain.withColumn("value", F.col("value") * 7), 3).withColumnRenamed("spi_gamma_3_month", "b")
    assert out.join(other, "time").agg(F.max(F.abs(F.col("spi_gamma_3_month") - F.col("b")))).first()[0] < 1e-8
    path = str(tmp_path / "params")
    save_params(fit_index_params(rain, "value", [3, 6]), path)
    again = spi(rain, 3, params=load_params(spark, path, 3)).withColumnRenamed("spi_gamma_3_month", "b")
    assert out.join(again, "time").agg(F.max(F.abs(F.col("spi_gamma_3_month") - F.col("b")))).first()[0] < 1e-9
    with pytest.raises(KeyError):
        load_params(spark, path, 9)
    with pytest.raises(FileNotFoundError):
        load_params(spark, str(tmp_path / "none"), 3)
    assert attributes_of(out, "spi_gamma_3_month")["scale"] == 3


@pytest.mark.parametrize("family", ["pearson3", "log_logistic", "gev"])
def test_other_families_agree_with_gamma(rain, family):
    out = spi(rain, 3, distribution=family)
    ref = spi(rain, 3).select("time", "spi_gamma_3_month")
    both = out.join(ref, "time").where(f"spi_{family}_3_month is not null")
    assert both.count() > 300 and both.agg(F.corr(f"spi_{family}_3_month", "spi_gamma_3_month")).first()[0] > 0.95


def test_one_shuffle_for_several_scales(rain):
    plan = spi(rain, [1, 3, 6])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_spei_sources(spark, rain):
    df = rain.withColumns({"t": F.lit(25.0) + F.month("time") / 4, "lat": F.lit(-8.5), "precip": F.col("value")})
    a = spei(df, 3, temperature="t", latitude="lat")
    assert a.where("spei_gamma_3_month is not null").count() == 478
    pet = thornthwaite(df, "t").select("cell_id", "time", "pet")
    b = spei(df.select("cell_id", "time", "precip"), 3, pet=pet, validate=True).withColumnRenamed("spei_gamma_3_month", "b")
    assert a.join(b, "time").agg(F.max(F.abs(F.col("spei_gamma_3_month") - F.col("b")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        spei(df, 3)
    with pytest.raises(ValueError):
        spei(df, 3, "precip", pet=pet.limit(5), validate=True)


def test_evapotranspiration(spark):
    t = [25.0, 26, 27, 28, 29, 28, 27, 26, 26, 27, 27, 26]
    df = from_series(spark, t, "2024-01-01").select("cell_id", "time", F.col("value").alias("tmean"), (F.col("value") - 5).alias("tmin"), (F.col("value") + 5).alias("tmax"), F.lit(-8.5).alias("lat"))
    pet = [r.pet for r in hargreaves(df).collect()]
    assert len(pet) == 12 and all(0 < p < 300 for p in pet)
    assert {r.pet for r in thornthwaite(df.withColumn("tmean", F.lit(-3.0))).collect()} == {0.0}
    assert thornthwaite(df.withColumn("lat", F.lit(90.0))).where("pet is not null").count() == 0


def test_calendar(spark):
    days = spark.range(365).select(F.lit(0).alias("cell_id"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("time"), F.col("id").cast("double").alias("value"))
    wide = to_366(days)
    assert wide.count() == 366 and wide.where("day_366 = 60").first().value == 58.5
    assert to_gregorian(wide).exceptAll(days.select("cell_id", "time", "value")).count() == 0
    assert gregorian_length_as_366(365, 2001) == 366 and gregorian_length_as_366(59, 2001) == 59


def test_toolkit_guards(spark):
    few = from_series(spark, [1.0, 2, 3])
    got = fit.lmoments(few, ["cell_id"], "value").first()
    assert got.l1 is None
    samples = ([1.0, 2, 3], [5.0] * 40, [0.0] * 40, [1.0], [-1.0] * 20 + [1.0] * 20)
    rows = [(i, v) for i, vs in enumerate(samples) for v in vs]
    df = spark.createDataFrame([(i, float(v)) for i, v in rows], "cell_id int, value double").coalesce(1).cache()
    for family, method in (("gamma", "lmoments"), ("gamma", "mle"), ("pearson3", "lmoments"), ("log_logistic", "mle"), ("gev", "mle"), ("gen_logistic", "lmoments")):
        assert fit.fit(df, ["cell_id"], "value", family, method).count() == len(samples)
    d = fit.diagnose(from_series(spark, [None, 1.0]), ["cell_id"], "value").first()
    assert d.n_total == 2 and d.n_valid == 1 and not d.is_suitable_for_gamma and len(d.warnings) == 4
    none = fit.diagnose(from_series(spark, [None, None]), ["cell_id"], "value").first()
    assert none.warnings == ["no_values"] and none.zero_proportion == 1.0


def test_selection_prefers_a_fitting_family(spark, rain):
    best = fit.select_best(rain, ["cell_id"], "value", ["gamma", "gen_logistic"], "ks").first()
    assert best.distribution == "gamma"


def test_grid_helpers(spark, tmp_path):
    df = spark.createDataFrame([(0, "2000-01-01", float("nan")), (0, "2000-03-01", -9999.0), (1, "2000-02-01", 2.0)], "cell_id int, time string, v double")
    clean = missing_to_null(df, "v")
    assert clean.where("v is not null").count() == 1
    full = densify(clean.withColumn("time", F.col("time").cast("date")), "2000-01-01", "2000-03-01", "v")
    assert full.count() == 6
    c = completeness(full, "v").first()
    assert (c.total_cells, c.land_cells, c.ocean_cells) == (2, 1, 1)
    assert find_variable(["lat", "PPT_mm"], ["ppt"]) == "PPT_mm"
    for columns in (["a"], ["ppt1", "ppt2"]):
        with pytest.raises(ValueError):
            find_variable(columns, ["ppt"])
    assert find_variable(["a", "b"], ["ppt"], exactly_one=False) == "a"


def test_paths(spark, rain, tmp_path):
    rain.withColumnRenamed("value", "precip").withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)}).write.parquet(str(tmp_path / "in"))
    seen = []
    out = spi_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), 3, params_path=str(tmp_path / "p"), progress=lambda s, p: seen.append(p))
    assert out.where("spi_gamma_3_month is not null").count() == 478 and seen == [50.0, 100.0]
    assert read_grid(spark, str(tmp_path / "in")).columns == ["cell_id", "lat", "lon", "time", "value"]
    save_index(out, str(tmp_path / "f"), ["spi_gamma_3_month"], as_float=True)
    assert dict(spark.read.parquet(str(tmp_path / "f")).dtypes)["spi_gamma_3_month"] == "float"


def test_names_and_planning(spark):
    assert variable_name("SPEI", 12, Periodicity.from_string("Monthly"), "pearson3") == "spei_pearson3_12_month"
    assert param_name("skew", 3, Periodicity.daily, "pearson3") == "skew_3_day"
    with pytest.raises(ValueError):
        param_name("skew", 3)
    attrs = global_attributes("t", "GEV", 1991, 2020, {"scales": [1]}, {"title": "mine"})
    assert attrs["title"] == "mine" and attrs["scales"] == [1] and "institution" not in attrs
    est = estimate_memory(528, 2160, 4320, available=16.0)
    assert not est.fits and est.n_chunks > 1 and estimate_memory(12, 10, 10, available=1.0).fits
    assert optimal_chunk(528, 50, 4320, available=1.0)[0] == 50
    table = [tuple(r) for r in tile_table(spark, 1100, 700).orderBy("tile").collect()]
    assert table == [tuple(t) for t in tiles(1100, 700)]
    assert len(climext.__all__) > 40


def test_generic_families_take_no_join(spark):
    """All scales are fitted in the rows' own partition: no join, one exchange of the data."""
    import numpy as np

    from climext import spi

    rng = np.random.default_rng(1)
    rows = [(c, f"{1980 + t // 12}-{1 + t % 12:02d}-01", float(v)) for c in range(2) for t, v in enumerate(rng.gamma(2.0, 30.0, 480))]
    df = spark.createDataFrame(rows, "cell_id long, time string, value double").selectExpr("cell_id", "cast(time as date) as time", "value").repartition(3)
    out = spi(df, [1, 3, 6], distribution="gev", start=1981, end=2015)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert out.where("year(time) > 1981").where("spi_gev_3_month is not null and spi_gev_6_month is not null").count() == 2 * 12 * 38
