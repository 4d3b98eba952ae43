"""Reading cubes, writing indices, saving and loading calibrations; path-to-path jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CALIBRATION_END, CALIBRATION_START, METADATA, PARAMS, PET_PATTERNS, PRECIP_PATTERNS, Distribution, Periodicity
from ..naming import variable_name
from ..operators.grid import find_variable, missing_to_null, normalize_columns
from ..operators.index import fit_index_params, spei, spi


def read_grid(spark: SparkSession, path: str, patterns: Sequence[str] | None = None, variable: str | None = None, fmt: str = "parquet") -> DataFrame:
    """(cell_id, [lat, lon,] time, value) of a cube stored as a table; missing values become null.

    Only the columns used are read.  Without ``cell_id``, cells are numbered by a hash of their place.
    """
    reader = spark.read.format(fmt)
    df = normalize_columns((reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path))
    names = [c for c in df.columns if c not in ("cell_id", "lat", "lon", "time")]
    value = variable or find_variable(names, patterns or PRECIP_PATTERNS, exactly_one=patterns is not None)
    place = [c for c in ("lat", "lon") if c in df.columns]
    cell = F.col("cell_id") if "cell_id" in df.columns else F.xxhash64(*place)
    out = df.select(cell.alias("cell_id"), *place, F.col("time").cast("date").alias("time"), F.col(value).alias("value"))
    return missing_to_null(out, "value")


def save_index(df: DataFrame, path: str, columns: Sequence[str], as_float: bool = False, compression: str = "zstd", fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write index columns with their keys; ``as_float`` halves them.  Column attributes stay with the files."""
    keys = [c for c in ("cell_id", "lat", "lon", "time") if c in df.columns]
    out = df.select(*keys, *(F.col(c).cast("float").alias(c, metadata=df.schema[c].metadata) if as_float else c for c in columns))
    if fmt == "csv":
        out.write.mode(mode).option("header", True).csv(path)
    else:
        out.write.mode(mode).option("compression", compression).parquet(path)
    return path


def save_params(
    params: DataFrame,
    path: str,
    index: str = "spi",
    periodicity: Periodicity = Periodicity.monthly,
    years: tuple[int, int] | None = None,
    attributes: dict[str, str] | None = None,
) -> str:
    """Write a params table, one folder for each index, family and scale; saving one again replaces only it.

    ``years``: first and last calibration year; ``attributes``: anything else to keep (METADATA's entries are added).
    """
    if not {"period", "scale_steps", "distribution"} <= {*params.columns}:
        raise ValueError(f"not a params table: {params.columns}")
    kept = {k: v for k, v in METADATA.items() if v} | {k: str(v) for k, v in (attributes or {}).items()}
    said = F.create_map(*(F.lit(x) for pair in sorted(kept.items()) for x in pair))
    first, last = years or (None, None)
    (
        params.withColumns(
            {
                "calibration_start": F.lit(first).cast("int"), "calibration_end": F.lit(last).cast("int"), "attributes": said,
                "index": F.lit(index), "periodicity": F.lit(periodicity.name), "family": F.col("distribution"), "steps": F.col("scale_steps"),
            }
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("index", "periodicity", "family", "steps")
        .parquet(path)
    )
    return path


def load_params(
    spark: SparkSession,
    path: str,
    scale: int,
    periodicity: Periodicity = Periodicity.monthly,
    distribution: str | None = None,
    index: str = "spi",
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """The saved table of one scale (partition pruning reads no other).

    The family is taken from the table if not given.  FileNotFoundError, KeyError as the names say; ValueError if the
    table was calibrated on other ``years``.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    df = df.where((F.col("index") == index) & (F.col("periodicity") == periodicity.name) & (F.col("steps") == scale))
    if distribution is None:
        found = sorted(r["family"] for r in df.select("family").distinct().collect())
        distribution = "gamma" if "gamma" in found or not found else found[0]
    family = Distribution.parse(distribution).value
    df = df.where(F.col("family") == family)
    if df.isEmpty():
        raise KeyError(f"no {family} parameters of scale {scale} in {path}")
    if years is not None:
        saved = [(r[0], r[1]) for r in df.select("calibration_start", "calibration_end").distinct().limit(2).collect()]
        if saved != [tuple(years)]:
            raise ValueError(f"calibrated on {saved}, not {years}")
    return df.select("cell_id", "period", "scale_steps", "distribution", *PARAMS[family], "prob_zero")


def calibration_of(spark: SparkSession, path: str) -> DataFrame:
    """One row for each saved table: index, periodicity, family, steps, calibration years, attributes."""
    keys = ["index", "periodicity", "family", "steps", "calibration_start", "calibration_end"]
    return spark.read.parquet(path).groupBy(*keys).agg(F.any_value("attributes").alias("attributes"))


def spi_path(spark: SparkSession, source: str, target: str, scale: int = 12, distribution: str = "gamma", params_path: str | None = None, variable: str | None = None, progress=None, **how) -> DataFrame:
    """Path to path: partitions stand for tiles.  ``progress(stage, percent)`` is called as stages end."""
    df = read_grid(spark, source, None, variable)
    params = None
    if params_path is not None:
        save_params(fit_index_params(df.withColumn("value", F.when(F.col("value") < 0, 0.0).otherwise(F.col("value"))), "value", [scale], distribution, **how), params_path, "spi", how.get("periodicity", Periodicity.monthly), (how.get("start", CALIBRATION_START), how.get("end", CALIBRATION_END)))
        params = load_params(spark, params_path, scale, how.get("periodicity", Periodicity.monthly), distribution)
        if progress:
            progress("params", 50.0)
    out = spi(df, scale, distribution=distribution, params=params, **how)
    save_index(out, target, [variable_name("spi", scale, how.get("periodicity", Periodicity.monthly), distribution)])
    if progress:
        progress("index", 100.0)
    return spark.read.parquet(target)


def spei_path(spark: SparkSession, precip: str, pet: str, target: str, scale: int = 12, distribution: str = "gamma", precip_variable: str | None = None, pet_variable: str | None = None, progress=None, **how) -> DataFrame:
    """Path to path, from stored precipitation and evapotranspiration."""
    p = read_grid(spark, precip, PRECIP_PATTERNS, precip_variable)
    e = read_grid(spark, pet, PET_PATTERNS, pet_variable).select("cell_id", "time", "value")
    out = spei(p.withColumnRenamed("value", "precip"), scale, pet=e, distribution=distribution, **how)
    save_index(out, target, [variable_name("spei", scale, how.get("periodicity", Periodicity.monthly), distribution)])
    if progress:
        progress("index", 100.0)
    return spark.read.parquet(target)


def location_filename(base: str, lat: float, lon: float, extension: str = "png", folder: str = "output") -> str:
    """A file name for one location; its folder is made."""
    import os

    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{base}_lat{lat:.2f}_lon{lon:.2f}.{extension}")
