"""Gridded files in the classic NetCDF format (CDF-1 and CDF-2), read and written without a library.

``spark.read.format("netcdf")`` gives (cell_id, lat, lon, time, value) of a variable over (time, lat, lon) in any order of
those dimensions.  A partition is a band of latitudes: it reads the header and its own slabs of the file, so nothing is read
whole, and cells keep their whole series in one partition.  Files are opened through Arrow's file systems, so any store that
they reach will do.  Writing makes one file for each band.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import METADATA
from ..session import ship

# Fixed values of the format: tags, and big-endian types by number.
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_UNITS = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
SCHEMA = "cell_id long, lat double, lon double, time date, value double"


class Variable(NamedTuple):
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attributes: dict
    dtype: np.dtype
    begin: int
    record: int  # bytes from one record to the next; 0 if the variable isn't of records


class Header(NamedTuple):
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, place


class _Bytes:
    """Big-endian numbers and names, read in order."""

    def __init__(self, file):
        self.file = file

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        if len(out) < n:
            raise ValueError("the header ends early")
        return out

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "big")

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def list_of(self, tag: int, one) -> list:
        got, n = self.number(), self.number()
        if got not in (0, tag):
            raise ValueError(f"unexpected tag {got}")
        return [one() for _ in range(n)] if got else []

    def attribute(self) -> tuple[str, object]:
        name, kind, n = self.name(), self.number(), self.number()
        kind = np.dtype(_TYPES[kind])
        raw = self.padded(n * kind.itemsize)
        if kind.kind == "S":
            return name, raw.decode("utf-8", "replace")
        values = np.frombuffer(raw, kind)
        return name, values[0].item() if n == 1 else values.tolist()


def read_header(file) -> Header:
    b = _Bytes(file)
    if b.take(3) != b"CDF" or (version := b.number(1)) not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    records = b.number()
    names: list[tuple[str, int]] = b.list_of(_DIMENSION, lambda: (b.name(), b.number()))
    attributes = dict(b.list_of(_ATTRIBUTE, b.attribute))

    def variable():
        name = b.name()
        ids = [b.number() for _ in range(b.number())]
        own = dict(b.list_of(_ATTRIBUTE, b.attribute))
        dtype = np.dtype(_TYPES[b.number()])
        b.number()
        return name, ids, own, dtype, b.number(4 if version == 1 else 8)

    found = b.list_of(_VARIABLE, variable)
    moving = [(ids, d) for _, ids, _, d, _ in found if ids and names[ids[0]][1] == 0]
    size = [int(np.prod([names[i][1] for i in ids[1:]], dtype=np.int64)) * d.itemsize for ids, d in moving]
    # the records of a single variable aren't padded
    record = size[0] if len(size) == 1 else sum(n + -n % 4 for n in size)
    out = {}
    for name, ids, own, dtype, begin in found:
        of_records = bool(ids) and names[ids[0]][1] == 0
        shape = tuple(records if names[i][1] == 0 else names[i][1] for i in ids)
        out[name] = Variable(tuple(names[i][0] for i in ids), shape, own, dtype, begin, record if of_records else 0)
    return Header({n: k or records for n, k in names}, attributes, out)


def read_slab(file, v: Variable, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The block of a variable within ``ranges`` of its dimensions, by runs of bytes that follow each other."""
    item = v.dtype.itemsize
    shape = [z - a for a, z in ranges]
    if not shape:
        file.seek(v.begin)
        return np.frombuffer(file.read(item), v.dtype)[0]
    # inner dimensions that are read whole belong to one run
    inner = len(shape)
    while inner > 1 and shape[inner - 1] == v.shape[inner - 1]:
        inner -= 1
    if v.record:
        inner = max(inner, 2) if len(shape) > 1 else 1
    steps = [int(np.prod(v.shape[i + 1 :], dtype=np.int64)) * item for i in range(len(shape))]
    if v.record:
        steps[0] = v.record
    run = int(np.prod(shape[inner - 1 :], dtype=np.int64))
    if v.record and len(shape) == 1:
        inner, run = 2, 1
    out = np.empty((int(np.prod(shape[: inner - 1], dtype=np.int64)), run), v.dtype)
    for n, at in enumerate(np.ndindex(*shape[: inner - 1])):
        place = v.begin + sum((a + i) * s for (a, _), i, s in zip(ranges, at, steps, strict=False))
        if inner - 1 < len(shape):
            place += ranges[inner - 1][0] * steps[inner - 1]
        file.seek(place)
        out[n] = np.frombuffer(file.read(run * item), v.dtype)
    return out.reshape(shape)


def decoded(x: np.ndarray, attributes: dict) -> np.ndarray:
    """Doubles with scale and offset applied; fill values become NaN."""
    y = x.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        if name in attributes:
            y[x == np.asarray(attributes[name], x.dtype)] = np.nan
    return y * attributes.get("scale_factor", 1.0) + attributes.get("add_offset", 0.0)


def decoded_time(x: np.ndarray, units: str) -> list[dt.date]:
    """Dates of a time axis such as "days since 1800-01-01"."""
    unit, _, origin = units.partition(" since ")
    if unit not in _UNITS:
        raise ValueError(f"time in {units!r} can't be read")
    zero = dt.datetime.fromisoformat(origin.strip().replace(" UTC", "").split(".")[0].rstrip("Z") if origin.strip() else "1970-01-01")
    return [(zero + dt.timedelta(seconds=float(v) * _UNITS[unit])).date() for v in x]


class _Band(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options.get("variable")
        self.rows = int(options.get("band", 16))

    def _layout(self, file) -> tuple[Header, str]:
        header = read_header(file)
        wanted = [n for n, v in header.variables.items() if sorted(v.dims) == ["lat", "lon", "time"]]
        name = self.variable or (wanted[0] if len(wanted) == 1 else None)
        if name not in wanted:
            raise ValueError(f"no single variable over time, lat and lon: {wanted}")
        return header, name

    def partitions(self) -> list[InputPartition]:
        system, place = _open(self.path)
        with system.open_input_file(place) as file:
            n = self._layout(file)[0].dims["lat"]
        return [_Band(a, min(a + self.rows, n)) for a in range(0, n, self.rows)]

    def read(self, partition: _Band) -> Iterator[pa.RecordBatch]:
        system, place = _open(self.path)
        with system.open_input_file(place) as file:
            header, name = self._layout(file)
            v, axis = header.variables[name], {}
            for d in ("time", "lat", "lon"):
                axis[d] = read_slab(file, header.variables[d], [(0, header.dims[d])])
            days = pa.array(decoded_time(axis["time"], header.variables["time"].attributes["units"]), pa.date32())
            wide, long = len(axis["lon"]), len(days)
            for i in range(partition.first, partition.last):
                x = read_slab(file, v, [(i, i + 1) if d == "lat" else (0, header.dims[d]) for d in v.dims])
                x = decoded(np.moveaxis(x, [v.dims.index(d) for d in ("lat", "lon", "time")], [0, 1, 2]).reshape(wide, long), v.attributes)
                flat = x.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(i * wide + np.arange(wide), long), pa.int64()),
                        pa.array(np.full(wide * long, float(axis["lat"][i]))),
                        pa.array(np.repeat(axis["lon"].astype(np.float64), long)),
                        pa.chunked_array([days] * wide).combine_chunks(),
                        pa.array(flat, mask=np.isnan(flat)),
                    ],
                    names=["cell_id", "lat", "lon", "time", "value"],
                )


class NetcdfSource(DataSource):
    """Options: path, variable (if there are several), band (latitudes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options)


def read_netcdf(spark: SparkSession, path: str, variable: str | None = None, band: int = 16) -> DataFrame:
    ship()
    spark.dataSource.register(NetcdfSource)
    reader = spark.read.format("netcdf").option("band", band)
    return (reader if variable is None else reader.option("variable", variable)).load(path)


# ---------------------------------------------------------------- writing


def _text(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(of: dict) -> bytes:
    if not of:
        return b"\0" * 8
    out = struct.pack(">ii", _ATTRIBUTE, len(of))
    for name, value in of.items():
        out += _text(name)
        if isinstance(value, str):
            out += struct.pack(">i", 2) + _text(value)
        else:
            out += struct.pack(">iid", 6, 1, float(value))
    return out


def encode(lat: np.ndarray, lon: np.ndarray, days: np.ndarray, values: np.ndarray, name: str, of: dict, whole: dict) -> bytes:
    """A CDF-2 file of one variable (time, lat, lon) of doubles; ``days`` since 1800-01-01."""
    sizes = (("time", len(days)), ("lat", len(lat)), ("lon", len(lon)))
    axes = (
        ("time", days, {"units": "days since 1800-01-01", "calendar": "gregorian"}),
        ("lat", lat, {"units": "degrees_north"}),
        ("lon", lon, {"units": "degrees_east"}),
    )
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", _DIMENSION, 3) + b"".join(_text(n) + struct.pack(">i", k) for n, k in sizes)
    head += _attributes(whole) + struct.pack(">ii", _VARIABLE, 4)
    parts = [(n, [i], a, x) for i, (n, x, a) in enumerate(axes)] + [(name, [0, 1, 2], {**of, "_FillValue": -9999.0}, values)]
    tops = [
        _text(n) + struct.pack(">i", len(ids)) + struct.pack(f">{len(ids)}i", *ids) + _attributes(a) + struct.pack(">ii", 6, min(x.size * 8, 2**31 - 4))
        for n, ids, a, x in parts
    ]
    at = len(head) + sum(len(t) + 8 for t in tops)
    body = b""
    for t, (_, _, _, x) in zip(tops, parts, strict=True):
        head += t + struct.pack(">q", at + len(body))
        body += np.where(np.isnan(x), -9999.0, x).astype(">f8").tobytes()
    return head + body


def write_netcdf(df: DataFrame, path: str, variable: str, band: float = 10.0, attributes: dict | None = None) -> DataFrame:
    """Write (lat, lon, time, ``variable``) as one file for each band of ``band`` degrees; (file, cells) of those written.

    The column's own attributes and METADATA go along; ``attributes`` are the file's.  A task holds one band.
    """
    ship()
    own = {k: v for k, v in (df.schema[variable].metadata or {}).items() if isinstance(v, (str, int, float))}
    whole = {k: v for k, v in METADATA.items() if v} | {k: str(v) for k, v in (attributes or {}).items()}
    system, place = _open(path)
    system.create_dir(place, recursive=True)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        lat, i = np.unique(part["lat"].to_numpy(float), return_inverse=True)
        lon, j = np.unique(part["lon"].to_numpy(float), return_inverse=True)
        days, t = np.unique(part["day"].to_numpy(float), return_inverse=True)
        values = np.full((len(days), len(lat), len(lon)), np.nan)
        values[t, i, j] = part["x"].to_numpy(float)
        file = f"band_{int(part['band'].iloc[0]):04d}.nc"
        system, place = _open(path)
        with system.open_output_stream(f"{place}/{file}") as out:
            out.write(encode(lat, lon, days, values, variable, own, whole))
        return pd.DataFrame({"file": [file], "cells": [len(set(zip(i.tolist(), j.tolist(), strict=True)))]})

    rows = df.select(
        F.floor((F.col("lat") + 90) / band).alias("band"), "lat", "lon",
        F.datediff("time", F.lit("1800-01-01").cast("date")).cast("double").alias("day"), F.col(variable).cast("double").alias("x"),
    )
    return df.sparkSession.createDataFrame(rows.groupBy("band").applyInPandas(write, "file string, cells long").collect(), "file string, cells long")
