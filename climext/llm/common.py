"""Session set-up, shared storage and vectorised text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent
U64 = np.uint64
MAX_ID = (1 << 63) - 1
#: Rows of an Arrow batch; texts of 100 kB then still make a batch of 50 MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once and keep Arrow batches small."""
    sc = spark.sparkContext
    if not getattr(sc, "_climext_shipped", False):
        folder = tempfile.mkdtemp(prefix="climext-src-")  # driver only; Spark serves the file from here
        target = os.path.join(folder, "climext_src.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(target)
        sc._climext_shipped = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests) a local one is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark.sparkContext, "_climext_dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="climext-")
            spark.sparkContext._climext_dir = path
    return path.rstrip("/")


def _written(spark: SparkSession) -> list[str]:
    """Folders that this application has written and not yet deleted, in order."""
    if not hasattr(spark.sparkContext, "_climext_written"):
        spark.sparkContext._climext_written = []
    return spark.sparkContext._climext_written


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The folder goes when the application ends, or with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/climext-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written(spark).append(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def bookmark(spark: SparkSession) -> int:
    return len(_written(spark))


def discard(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the folders written since a bookmark, but the last ``but``; nothing that is yet to be read may need them."""
    paths = _written(spark)
    gone = paths[since : len(paths) - but]
    for path in gone:
        folder, files = _folder(spark, path)
        files.delete(folder, True)
    paths[since : len(paths) - but] = []


def keyed(docs: DataFrame) -> DataFrame:
    """(__id, __none, __key, text): never-null id (null sorts last), whether it is null, hash of the text, text without null.

    Rows that agree in ``__id``, ``__none`` and ``__key`` are repeated rows: they share every result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("__id"),
        F.col("doc_id").cast("long").isNull().alias("__none"),
        F.xxhash64(text).alias("__key"),
        text.alias("text"),
    )


def with_key(docs: DataFrame) -> DataFrame:
    """The input rows with ``__id``, ``__none`` and ``__key`` appended, for joining results back."""
    return docs.withColumns(
        {
            "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)),
            "__none": F.col("doc_id").cast("long").isNull(),
            "__key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )


def wrapped(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id, text and all other columns as one, so that no name of theirs can clash; and what unwraps rows again."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return docs, lambda df: df.select(*docs.columns)
    inner = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__rest"))
    return inner, lambda df: df.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns))


def compressed(df: DataFrame) -> DataFrame:
    """``text`` as zstd frames: half the bytes in a shuffle of whole texts."""
    import zstandard

    schema = df.withColumn("text", F.lit(None).cast("binary")).schema

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.schema.get_field_index("text")
            frames = [zip_.compress(x or b"") for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.set_column(at, "text", pa.array(frames, pa.binary()))

    return df.mapInArrow(run, schema)


def plain(frames: pa.Array) -> pa.Array:
    """The texts of compressed ones."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    return pa.array([unzip.decompress(x) for x in frames.to_pylist()], pa.binary()).cast(pa.string())


# ---------------------------------------------------------------- vectorised text


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, elementwise on uint64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 -> float in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that separate words when only ASCII white space does: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words for comparison: letters, digits and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")] = True
WORD[128:] = True

_P = 0x9E3779B97F4A7C55 | 1
_PI = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, U64)
        step, filled = U64(base), 1
        # doubling: out[k:2k] = out[:k] * base**k
        while filled < size:
            take = min(filled, size - filled)
            out[filled : filled + take] = out[:take] * step
            with np.errstate(over="ignore"):
                step = step * step
            filled += take
        _powers[str(base)] = have = out
    return have[:n]


class Tokens:
    """Words of a batch of texts: byte range, document number and 64-bit hash of each."""

    __slots__ = ("doc", "end", "first", "hash", "raw", "start")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashes: bool = True):
        n = len(raw)
        self.raw = raw
        inside = is_word[raw]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        edges = offsets[1:-1]
        before[edges[edges < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        after[edges[(edges > 0)] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: first[d] is the number of the first word of document d
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)), "left")
        self.hash = None
        if hashes:
            with np.errstate(over="ignore"):
                sums = np.zeros(n + 1, U64)
                np.cumsum(raw.astype(U64) * _power(_P, n), out=sums[1:])
                h = (sums[self.end] - sums[self.start]) * _power(_PI, n + 1)[self.start]
                self.hash = mix(h ^ (self.end - self.start).astype(U64))


def text_blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of documents of about ``most`` bytes; a longer document makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Bytes of text that are looked into at once; arrays of 10 to 40 bytes a byte of text then stay near 20 MB.
PIECE = 1 << 19


def word_pieces(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE, apart: np.ndarray = SPACE):
    """(start, end, document edges, is one word) of pieces of a block of :func:`text_blocks`.

    A block of several documents is a piece; a longer document is cut where words end (after a byte of ``apart``).
    A word of ``most`` bytes or more is a piece of its own.
    """
    n, a = len(raw), 0
    if len(offsets) > 2 or n < most:
        yield 0, n, offsets, False
        return
    while a < n:
        z = min(a + most, n)
        gaps = np.flatnonzero(apart[raw[a:z]])
        whole = not len(gaps) and z - a == most
        if whole:
            while z < n and not len(gaps):
                gaps = np.flatnonzero(apart[raw[z : z + most]])
                z = z + int(gaps[0]) if len(gaps) else min(z + most, n)
        elif z < n:
            z = a + int(gaps[-1]) + 1
        yield a, z, np.asarray([0, z - a]), whole
        a = z


def long_word_hash(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of a word too long for :class:`Tokens`."""
    return np.asarray([xxhash.xxh64_intdigest(np.ascontiguousarray(raw).data)], U64)


class Words:
    """Word hashes of a block in order, and where each document's begin; 8 bytes a word stay, whatever the text."""

    __slots__ = ("first", "hash")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int = PIECE):
        found, first = [], np.zeros(len(offsets), np.int64)
        for a, z, edges, whole in word_pieces(raw, offsets, most, ~is_word):
            if whole:
                found.append(long_word_hash(raw[a:z]))
                continue
            t = Tokens(raw[a:z], edges, is_word)
            found.append(t.hash)
            if len(offsets) > 2:
                first = t.first
        self.hash = np.concatenate(found) if found else np.zeros(0, U64)
        self.first = np.asarray([0, len(self.hash)]) if len(offsets) == 2 else first


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (length n-k+1, or empty)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= U64(0xD6E8FEB86659FD93)
            out += h[j : j + n]
        return mix(out)
