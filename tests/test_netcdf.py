"""Classic NetCDF: round trips, a header made by hand, records, packed values."""

import datetime as dt
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext.sources import netcdf


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(2)
    rows = [
        (lat, lon, dt.date(1990 + t // 12, 1 + t % 12, 1), None if (t + int(lon)) % 7 == 0 else float(rng.normal()))
        for lat in (-12.5, -2.5, 7.5) for lon in (100.0, 101.0) for t in range(24)
    ]
    return spark.createDataFrame(rows, "lat double, lon double, time date, rain double")


def test_round_trip(spark, cube, tmp_path):
    df = cube.withColumn("rain", F.col("rain").alias("rain", metadata={"units": "mm", "long_name": "monthly rain"}))
    made = netcdf.write_netcdf(df, str(tmp_path), "rain", band=10.0, attributes={"title": "a test"})
    assert {(r["file"], r["cells"]) for r in made.collect()} == {("band_0007.nc", 2), ("band_0008.nc", 2), ("band_0009.nc", 2)}
    got = set()
    for r in made.collect():
        for band in (1, 16):
            back = netcdf.read_netcdf(spark, str(tmp_path / r["file"]), band=band)
            rows = {(x["lat"], x["lon"], x["time"], x["value"]) for x in back.collect()}
            got |= rows
    assert got == {tuple(r) for r in cube.collect()}
    with open(tmp_path / "band_0007.nc", "rb") as f:
        head = netcdf.read_header(f)
    assert head.attributes["title"] == "a test" and head.variables["rain"].attributes["units"] == "mm"


def test_records_and_packed_shorts(spark, tmp_path):
    """Time as the record dimension, lon before lat, shorts with scale and offset, as other tools write them."""
    text = netcdf._text
    times, lat, lon = [0, 31, 59], [1.0, 2.0], [5.0, 6.0, 7.0]
    x = np.arange(18).reshape(3, 3, 2).astype(">i2")
    x[1, 1, 1] = -1
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", 2) + text("lon") + struct.pack(">i", 3)
    head += b"\0" * 8 + struct.pack(">ii", 11, 4)
    fill = struct.pack(">ii", 12, 3) + text("_FillValue") + struct.pack(">iih", 3, 1, -1) + b"\0\0" + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("add_offset") + struct.pack(">iid", 6, 1, 10.0)
    units = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text("days since 2001-01-01")
    tops = [
        text("lat") + struct.pack(">ii", 1, 1) + b"\0" * 8 + struct.pack(">ii", 6, 16),
        text("lon") + struct.pack(">ii", 1, 2) + b"\0" * 8 + struct.pack(">ii", 6, 24),
        text("time") + struct.pack(">ii", 1, 0) + units + struct.pack(">ii", 4, 4),
        text("ppt") + struct.pack(">iiii", 3, 0, 2, 1) + fill + struct.pack(">ii", 3, 12),
    ]
    at = len(head) + sum(len(t) + 4 for t in tops)
    begins = [at, at + 16, at + 40, at + 44]
    raw = head + b"".join(t + struct.pack(">i", b) for t, b in zip(tops, begins, strict=True))
    raw += np.asarray(lat, ">f8").tobytes() + np.asarray(lon, ">f8").tobytes()
    for t in range(3):
        raw += struct.pack(">i", times[t]) + x[t].tobytes()
    (tmp_path / "a.nc").write_bytes(raw)
    head = netcdf.read_header(io.BytesIO(raw))
    assert head.dims == {"time": 3, "lat": 2, "lon": 3} and head.variables["ppt"].record == 16
    rows = netcdf.read_netcdf(spark, str(tmp_path / "a.nc"), "ppt", band=1).collect()
    want = {
        (a, o, dt.date(2001, 1, 1) + dt.timedelta(times[t])): None if (t, j, i) == (1, 1, 1) else 10 + 0.5 * (6 * t + 2 * j + i)
        for t in range(3) for i, a in enumerate(lat) for j, o in enumerate(lon)
    }
    assert {(r["lat"], r["lon"], r["time"]): r["value"] for r in rows} == want
    assert len({r["cell_id"] for r in rows}) == 6


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "b.nc").write_bytes(b"\x89HDF not classic")
    with pytest.raises(Exception, match="classic NetCDF"):
        netcdf.read_netcdf(spark, str(tmp_path / "b.nc")).collect()
    with pytest.raises(ValueError):
        netcdf.decoded_time(np.zeros(1), "months since 2000-01-01")
