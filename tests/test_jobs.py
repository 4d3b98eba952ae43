"""Tile jobs, saved calibrations, range errors, daily series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext import spi
from climext.config import Periodicity
from climext.operators.grid import densify
from climext.operators.index import fit_index_params
from climext.operators.pet import solar_declination, sunset_hour_angle, thornthwaite
from climext.plans import jobs
from climext.sources import io


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c, (lat, lon) in enumerate([(-35.0, -170.0), (-35.0, 25.0), (12.0, 25.0), (12.5, 26.0), (89.9, 179.9)]):
        rows += [(c, lat, lon, f"{1991 + t // 12}-{1 + t % 12:02d}-01", float(v)) for t, v in enumerate(rng.gamma(2.0, 30.0, 120))]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double, time string, value double")
    return df.withColumn("time", F.col("time").cast("date")).cache()


def scored(df):
    return spi(df, 3, start=1991, end=2000)


def rows_of(df):
    return {(r["cell_id"], r["time"]): r["spi_gamma_3_month"] for r in df.collect()}


def test_tiles_resume_and_rewrite(spark, cube, tmp_path):
    want = rows_of(scored(cube))
    target, said = str(tmp_path / "out"), []

    def broken(df):
        if said:
            raise RuntimeError("stopped")
        return scored(df)

    with pytest.raises(RuntimeError):
        jobs.run_tiles(spark, cube, target, broken, tiles_per_job=2, progress=lambda *a: said.append(a))
    assert len(said) == 2 and len(jobs.done_tiles(spark, target)) == 2
    seen = []
    out = jobs.run_tiles(spark, cube, target, lambda df: seen.append(df) or scored(df), tiles_per_job=2, progress=lambda *a: said.append(a))
    assert len(seen) == 1 and [a[1:] for a in said] == [(n, 4) for n in range(1, 5)]
    assert rows_of(out) == want
    # one tile again, with other values; the others stay
    tile = said[0][0]
    again = jobs.run_tiles(spark, cube, target, lambda df: scored(df).withColumn("spi_gamma_3_month", F.lit(9.0)), only=[tile])
    got = rows_of(again)
    mine = {(r["cell_id"], r["time"]) for r in again.where(F.col("tile") == tile).collect()}
    assert mine and all(got[k] == 9.0 if k in mine else got[k] == want[k] for k in want)


def test_tile_numbers(spark):
    for degrees in (10.0, 7.0):
        df = spark.createDataFrame([(a + 0.5, b + 0.5) for a in range(-90, 90, 17) for b in range(-180, 180, 31)], "lat double, lon double")
        for r in df.select("lat", "lon", jobs.tile_number(F.col("lat"), F.col("lon"), degrees).alias("t")).collect():
            south, north, west, east = jobs.tile_bounds(r["t"], degrees)
            assert south <= r["lat"] < north and west <= r["lon"] < east


def test_saved_calibrations_know_their_years(spark, cube, tmp_path):
    params = fit_index_params(cube, "value", [3], start=1991, end=1998)
    path = io.save_params(params, str(tmp_path / "p"), years=(1991, 1998), attributes={"made_by": "a test"})
    assert io.load_params(spark, path, 3, years=(1991, 1998)).count() == params.count()
    with pytest.raises(ValueError):
        io.load_params(spark, path, 3, years=(1991, 2000))
    said = io.calibration_of(spark, path).first()
    assert (said["calibration_start"], said["calibration_end"], said["attributes"]["made_by"]) == (1991, 1998, "a test")


def test_range_errors(spark):
    df = spark.createDataFrame([(0.5, 367)], "lat double, day int")
    with pytest.raises(Exception, match="day of the year must be in"):
        df.select(solar_declination(F.col("day"))).collect()
    with pytest.raises(Exception, match="latitude in radians must be in"):
        df.select(sunset_hour_angle(F.col("lat") + 2, F.lit(0.1))).collect()
    assert df.select(solar_declination(F.lit(None).cast("int"))).first()[0] is None
    far = spark.createDataFrame([(0, "2000-01-01", 20.0, 95.0), (1, "2000-01-01", 20.0, 45.0)], "cell_id int, time string, tmean double, lat double")
    got = {r["cell_id"]: r["pet"] for r in thornthwaite(far.withColumn("time", F.col("time").cast("date"))).collect()}
    assert got[0] is None and got[1] > 0


def test_daily_series(spark):
    df = spark.createDataFrame([(0, "2000-02-28", 1.0), (0, "2000-03-02", 2.0)], "cell_id int, time string, value double")
    full = densify(df, "2000-02-28", "2000-03-02", fill=0.0, periodicity=Periodicity.daily).orderBy("time").collect()
    assert [r["value"] for r in full] == [1.0, 0.0, 0.0, 2.0]
