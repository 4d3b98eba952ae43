"""Sequence packing: best-fit decreasing, packed id matrices, certified repacking.

Definitions for unusual input: a null text counts as empty; an empty document is
its end id alone, so every row is packed; repeated rows are packed once each;
columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare
from .tokens import encoder


class CapacityTree:
    """Segment tree over remaining capacities: the smallest one >= need that some bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a fullest bin that still holds ``need``; the bin leaves the tree."""
        i, up = need + self.size, self.any
        if not up[i]:
            while i > 1 and (i & 1 or not up[i + 1]):  # climb until a right sibling has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                i += not up[i]
        room = i - self.size
        b = self.bins[room].pop()
        if not self.bins[room]:
            while i and up[i]:
                up[i] = 0
                i >>= 1
                if i and (up[2 * i] or up[2 * i + 1]):
                    break
        return room, b


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item (in the given order), and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    tree, bins = CapacityTree(capacity), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        got = tree.take(n)
        if got is None:
            room, b, bins = capacity, bins, bins + 1
        else:
            room, b = got
        where[i], offset[i] = b, capacity - room
        if room > n:
            tree.put(room - n, b)
    return where, offset, bins


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> float:
    """The largest lower bound (not rounded up) on the bins, over two families of dual feasible functions.

    Threshold functions: sizes over C-k count as C, sizes under k as nothing, others as they are (k to C/2).
    Rounding functions: (k+1)x/C if whole counts x, else floor((k+1)x/C) C/k (k to 64).
    """
    if not len(lengths):
        return 0.0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.float64)
    size = np.arange(capacity + 1)
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    k = np.arange(0, capacity // 2 + 1)
    high = capacity - k
    best = ((mass[high + 1] - mass[k]) / capacity + many[-1] - many[high + 1]).max()
    for j in range(1, 65):
        whole = (j + 1) * size % capacity == 0
        f = np.where(whole, size * j, (j + 1) * size // capacity * capacity)  # times j
        best = max(best, float((f * count).sum()) / (j * capacity))
    return float(best)


# ---------------------------------------------------------------- certified repacking

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document with its end id."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            ids, counts = enc.encode(b.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = (np.cumsum(counts) - counts)[doc] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, PIECES
    )


_PACKED = "rid long, pid long, bin long, offset long, bins long, bound double, fill long, length long"


def _pack_partitions(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing within each ``pid``, with the partition's bin count and lower bound."""

    def run(key, part):
        part = part.sort_values(["length", "rid"], ascending=[False, True])
        lengths = part["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        return pd.DataFrame(
            {
                "rid": part["rid"].to_numpy(),
                "pid": key[0],
                "bin": where,
                "offset": offset,
                "bins": bins,
                "bound": dual_feasible_bound(lengths, capacity),
                "fill": fill[where],
                "length": lengths,
            }
        )

    return items.select("pid", "rid", "length").groupBy("pid").applyInPandas(run, _PACKED)


def _certified_anew(left: DataFrame, capacity: int) -> DataFrame:
    """What stays of partitions after an exchange, with the count and bound of just that."""

    def run(part):
        return part.assign(bins=part["bin"].nunique(), bound=dual_feasible_bound(part["length"].to_numpy(), capacity))

    return left.groupBy("pid").applyInPandas(run, left.schema)


def pack_certified(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    partition_bins: int = 4096,
    partition_pieces: int = 200_000,
    slack: float = 0.02,
    rounds: int | None = None,
) -> DataFrame:
    """Pack all documents into few sequences of ``capacity`` ids.

    Pieces are dealt evenly over partitions of about ``partition_bins`` sequences.  Each partition is
    packed by best-fit decreasing and certified by its dual-feasible lower bound.  Partitions whose count
    exceeds the (unrounded) bound by more than ``slack`` hand in the documents of their emptiest sequences;
    these are pooled over all partitions, dealt anew and packed again, as long as that saves sequences (or
    ``rounds`` times).
    ``partition_bins`` and ``partition_bound`` are those of a partition without what it handed in.

    A task holds one partition's lengths only; texts and ids are never gathered.
    """
    spark = prepare(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("rid", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")

    def deal(items: DataFrame, first: int) -> tuple[DataFrame, int, int]:
        n, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        parts = max(1, -(-tokens // (capacity * partition_bins)), -(-n // partition_pieces))
        pid = F.pmod(F.xxhash64("rid", F.lit(first)), F.lit(parts)) + F.lit(first)
        packed = _pack_partitions(items.select("rid", "length", pid.alias("pid")), capacity)
        return materialize(packed, "packed"), parts, n

    placed, parts, n = deal(pieces, 0)
    settled, base = [], parts
    turn = 0
    while parts > 1 and turn != rounds:
        turn += 1
        # the emptiest sequences of each partition that its bound doesn't certify: the gap, and one more
        open_bins = placed.where(F.col("bins") > F.col("bound") + slack).select("pid", "bin", "fill", "bins", "bound").distinct()
        gap = F.floor(F.col("bins") - F.col("bound")) + 1
        rank = F.row_number().over(_by_fill())
        handed = open_bins.withColumn("rank", rank).where(F.col("rank") <= gap).select("pid", "bin")
        handed = materialize(handed, "handed")
        old = handed.count()
        if old < 2:
            break
        pool = placed.join(handed, ["pid", "bin"], "left_semi").select("rid").join(pieces.select("rid", "length"), "rid")
        again, parts_again, _ = deal(pool, base)
        new = again.select("pid", "bin").distinct().count()
        base += parts_again
        if new >= old:
            break
        settled.append(_certified_anew(placed.join(handed, ["pid", "bin"], "left_anti"), capacity))
        placed, parts = again, parts_again
    for done in settled:
        placed = placed.unionByName(done)
    return pieces.join(placed.drop("length"), "rid").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("pid") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"),
        "offset",
        F.col("bins").alias("partition_bins"),
        F.ceil(F.col("bound") - 1e-9).cast("long").alias("partition_bound"),
    )


def _by_fill():
    from pyspark.sql import Window

    return Window.partitionBy("pid").orderBy("fill", "bin")


# ---------------------------------------------------------------- packed matrices

MATRIX = (
    "shard int, row long, n_tokens int, doc_ids array<long>, piece_starts array<long>, "
    "cu_seqlens array<int>, ids binary, position_ids binary"
)


def packed_matrices(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 49407,
    pad_id: int = 0,
    window_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per packed sequence: a row of the shard's id matrix and what goes with it.

    ``ids``: ``capacity`` little-endian uint32 (padded with ``pad_id``); ``position_ids``: as many uint16 that
    start from 0 with each segment (and with the padding); ``cu_seqlens``: cumulative segment lengths from 0;
    ``doc_ids`` and ``piece_starts``: which document, and how many of its ids come before.  Documents of more
    ids than ``capacity`` are cut into pieces that join to the whole again.

    Each task packs the documents of its input split (a shard) in windows of ``window_tokens`` ids, so nothing
    is shuffled, a task's memory is bounded, and a lost task is packed alike again.
    """
    prepare(docs.sparkSession)
    assert capacity <= 65536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, row = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held, tokens = [], 0
        for b in batches:
            ids, counts = enc.encode(b.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            doc_ids = b.column("doc_id").to_pylist()
            ends = np.cumsum(counts + 1)
            # a batch of very long texts is handed over in parts
            lo = 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + window_tokens, "right")))
                s, e = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
                held.append((ids[s:e], ends[lo:hi] - s, doc_ids[lo:hi]))
                tokens += e - s
                lo = hi
                if tokens >= window_tokens:
                    for made in _matrix_rows(held, capacity, pad_id, shard, row):
                        yield made
                        row += made.num_rows
                    held, tokens = [], 0
        if held:
            yield from _matrix_rows(held, capacity, pad_id, shard, row)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, MATRIX
    )


def _matrix_rows(held: list, capacity: int, pad_id: int, shard: int, row: int) -> Iterator[pa.RecordBatch]:
    segments, lengths = [], []
    for ids, ends, doc_ids in held:
        lo = 0
        for d, hi in zip(doc_ids, ends.tolist(), strict=True):
            for s in range(lo, hi, capacity):
                segments.append((d, s - lo, ids[s : min(s + capacity, hi)]))
                lengths.append(min(capacity, hi - s))
            lo = hi
    where, offset, bins = best_fit_decreasing(np.asarray(lengths, np.int64), capacity)
    order = np.lexsort((offset, where))
    cuts = np.searchsorted(where[order], np.arange(bins + 1))
    for first in range(0, bins, 256):
        out = {k: [] for k in ("n_tokens", "doc_ids", "piece_starts", "cu_seqlens", "ids", "position_ids")}
        stop = min(first + 256, bins)
        for b in range(first, stop):
            mine = [segments[i] for i in order[cuts[b] : cuts[b + 1]]]
            cu = np.cumsum([0, *(len(x[2]) for x in mine)])
            ids = np.full(capacity, pad_id, "<u4")
            ids[: cu[-1]] = np.concatenate([x[2] for x in mine])
            at = np.arange(capacity)
            positions = at - cu[np.searchsorted(cu, at, "right") - 1]
            out["n_tokens"].append(int(cu[-1]))
            out["doc_ids"].append([x[0] for x in mine])
            out["piece_starts"].append([x[1] for x in mine])
            out["cu_seqlens"].append(cu.tolist())
            out["ids"].append(ids.tobytes())
            out["position_ids"].append(positions.astype("<u2").tobytes())
        n = stop - first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * n, pa.int32()),
                pa.array(range(row + first, row + stop), pa.int64()),
                pa.array(out["n_tokens"], pa.int32()),
                pa.array(out["doc_ids"], pa.list_(pa.int64())),
                pa.array(out["piece_starts"], pa.list_(pa.int64())),
                pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                pa.array(out["ids"], pa.binary()),
                pa.array(out["position_ids"], pa.binary()),
            ],
            names=["shard", "row", *out],
        )


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet files, one for each shard (or more); ``shard`` and ``row`` are columns of theirs."""
    packed.write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_row(ids: bytes, cu_seqlens: list[int]) -> list[np.ndarray]:
    """The segments of a stored row."""
    x = np.frombuffer(ids, "<u4")
    return [x[a:b] for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)]
