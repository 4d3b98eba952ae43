"""Sizing: memory and tiles of a grid, and Spark settings that follow from them."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK, MEMORY_MULTIPLIER, MEMORY_SAFETY, MIN_CHUNK

GB = 1 << 30


class MemoryEstimate(NamedTuple):
    input_gb: float
    peak_gb: float
    chunk: tuple[int, int]
    n_chunks: int
    available_gb: float
    fits: bool


class Tile(NamedTuple):
    id: int
    lat_start: int
    lat_end: int
    lon_start: int
    lon_end: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.lat_end - self.lat_start, self.lon_end - self.lon_start


def available_gb() -> float:
    try:
        return os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / GB
    except (ValueError, OSError):
        return 16.0


def _side(n_time: int, available: float, multiplier: float, safety: float) -> int:
    """Edge of the square tile that fits."""
    return math.isqrt(max(0, int(available * safety / multiplier * GB / (n_time * 8))))


def estimate_memory(
    n_time: int, n_lat: int, n_lon: int, available: float | None = None, multiplier: float = MEMORY_MULTIPLIER, safety: float = MEMORY_SAFETY
) -> MemoryEstimate:
    available = available_gb() if available is None else available
    size = n_time * n_lat * n_lon * 8 / GB
    if size * multiplier <= available * safety:
        return MemoryEstimate(size, size * multiplier, (n_lat, n_lon), 1, available, True)
    side = _side(n_time, available, multiplier, safety)
    lat, lon = (max(min(side, n), MIN_CHUNK) for n in (n_lat, n_lon))
    return MemoryEstimate(size, size * multiplier, (lat, lon), -(-n_lat // lat) * -(-n_lon // lon), available, False)


def memory_report(e: MemoryEstimate) -> str:
    """The estimate as text."""
    lines = [f"input {e.input_gb:.2f} GB, peak {e.peak_gb:.2f} GB of {e.available_gb:.2f} GB available"]
    if e.fits:
        lines.append("the whole grid fits")
    else:
        lines.append(f"{e.n_chunks} tiles of {e.chunk[0]} x {e.chunk[1]} cells")
    return "\n".join(lines)


def estimates(spark: SparkSession, shapes: Sequence[tuple[int, int, int]], available: float) -> DataFrame:
    """One row for each shape (time, lat, lon) with its estimate."""
    rows = []
    for shape in shapes:
        e = estimate_memory(*shape, available)
        rows.append((*shape, e.input_gb, e.peak_gb, *e.chunk, e.n_chunks, e.fits))
    return spark.createDataFrame(rows, "n_time int, n_lat int, n_lon int, input_gb double, peak_gb double, chunk_lat int, chunk_lon int, n_chunks int, fits boolean")


def estimate_memory_of(df: DataFrame, available: float | None = None) -> MemoryEstimate:
    """Estimate for a cube stored as a table with lat, lon and time."""
    n = df.agg(*(F.count_distinct(c).alias(c) for c in ("time", "lat", "lon"))).first()
    return estimate_memory(n["time"], n["lat"], n["lon"], available)


def optimal_chunk(n_time: int, n_lat: int, n_lon: int, available: float | None = None, multiplier: float = MEMORY_MULTIPLIER, safety: float = MEMORY_SAFETY) -> tuple[int, int]:
    """Tile edges; unlike :func:`estimate_memory` the grid's size wins over the least edge."""
    side = _side(n_time, available_gb() if available is None else available, multiplier, safety)
    return min(max(side, MIN_CHUNK), n_lat), min(max(side, MIN_CHUNK), n_lon)


def tiles(n_lat: int, n_lon: int, lat: int = CHUNK, lon: int = CHUNK) -> Iterator[Tile]:
    """Tiles in row-major order."""
    n = 0
    for a in range(0, n_lat, lat):
        for b in range(0, n_lon, lon):
            yield Tile(n, a, min(a + lat, n_lat), b, min(b + lon, n_lon))
            n += 1


def tile_table(spark: SparkSession, n_lat: int, n_lon: int, lat: int = CHUNK, lon: int = CHUNK) -> DataFrame:
    """The same tiles as a table, made on the executors."""
    across = -(-n_lon // lon)
    i, j = F.floor(F.col("id") / across), F.col("id") % across
    end = lambda c, step, n: F.least((c + 1) * step, F.lit(n)).cast("int")
    return spark.range(-(-n_lat // lat) * across).select(
        F.col("id").cast("int").alias("tile"),
        (i * lat).cast("int").alias("lat_start"),
        end(i, lat, n_lat).alias("lat_end"),
        (j * lon).cast("int").alias("lon_start"),
        end(j, lon, n_lon).alias("lon_end"),
    )


def shuffle_partitions(n_time: int, n_cells: int, target_mb: int = 128) -> int:
    """Partitions of about ``target_mb`` for a shuffle of the whole cube (24 bytes a row)."""
    return max(8, math.ceil(n_time * n_cells * 24 / (target_mb << 20)))


def array_gb(shape: tuple[int, ...], item: int = 8) -> float:
    return math.prod(shape) * item / GB
