"""Path-to-path jobs tile by tile: what is done stays done, a stopped job goes on where it was, single tiles can be redone.

A tile is a square of so many degrees.  Each job takes a group of tiles: it reads no other rows, computes them in one
plan and replaces just their folders.  The tiles that a job has written are noted once it has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_grid

#: Inside the target, and no part of it to readers.
DONE = "_done"


def tile_number(lat: Column, lon: Column, degrees: float) -> Column:
    """Tiles in row-major order from the south-west corner."""
    across = int(-(-360 // degrees))
    return (F.floor((lat + 90) / degrees) * across + F.floor(F.pmod(lon + 180, F.lit(360.0)) / degrees)).cast("int")


def tile_bounds(tile: int, degrees: float) -> tuple[float, float, float, float]:
    """(south, north, west, east)."""
    i, j = divmod(tile, int(-(-360 // degrees)))
    return i * degrees - 90, (i + 1) * degrees - 90, j * degrees - 180, (j + 1) * degrees - 180


def done_tiles(spark: SparkSession, target: str) -> set[int]:
    try:
        return {r["tile"] for r in spark.read.schema("tile int").parquet(f"{target}/{DONE}").distinct().collect()}
    except AnalysisException:
        return set()


def run_tiles(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    make: Callable[[DataFrame], DataFrame],
    degrees: float = 10.0,
    tiles_per_job: int = 16,
    resume: bool = True,
    only: Iterable[int] | None = None,
    progress: Callable[[int, int, int], None] | None = None,
    variable: str | None = None,
) -> DataFrame:
    """Write ``make(rows)`` of every tile under ``target`` (partitioned by ``tile``) and read the whole back.

    ``source``: a stored cube or a table with lat and lon.  ``make`` gets whole series and keeps the column ``tile``.  With
    ``resume``, tiles noted as done are left alone; ``only`` does these tiles, done or not.  ``progress(tile, done, all)`` is
    called for each tile as its job ends.  The number of tiles is bounded by the globe, whatever the cube.
    """
    df = read_grid(spark, source, None, variable) if isinstance(source, str) else source
    df = df.withColumn("tile", tile_number(F.col("lat"), F.col("lon"), degrees))
    tiles = sorted(r["tile"] for r in df.select("tile").where("tile is not null").distinct().collect())
    if only is not None:
        todo = sorted({*only} & {*tiles})
    else:
        ready = done_tiles(spark, target) if resume else set()
        todo = [t for t in tiles if t not in ready]
    count = len(tiles) - len(todo)
    for at in range(0, len(todo), tiles_per_job):
        group = todo[at : at + tiles_per_job]
        bounds = [tile_bounds(t, degrees) for t in group]
        # a range that the scan can skip row groups by, then the tiles themselves
        rows = df.where(F.col("lat").between(min(b[0] for b in bounds), max(b[1] for b in bounds)) & F.col("tile").isin(group))
        out = make(rows)
        if "tile" not in out.columns:
            raise ValueError("the tile of each row is needed to write it")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(target)
        spark.createDataFrame([(t,) for t in group], "tile int").coalesce(1).write.mode("append").parquet(f"{target}/{DONE}")
        for t in group:
            count += 1
            if progress:
                progress(t, count, len(tiles))
    return spark.read.parquet(target)
