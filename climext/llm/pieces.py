"""Sampled subword segmentations by forward filtering and backward sampling; lossless decoding.

A text is cut before every space and around line breaks and tabs, where no piece crosses.  Each different
chunk of a block gets a lattice of vocabulary pieces over its bytes; forward filtering sums the weights of all
segmentations up to each place, and backward sampling draws pieces from the end to the start, each with its
posterior probability.  The random numbers are hashes of (seed, row key, place), so a row's segmentation is
the same in any batch, partition or retry.

Weights: the vocabulary's scores are merge ranks r; a piece has weight (r + 2.7)^-alpha, Zipf's law sharpened
by ``alpha`` (large: nearly always the likeliest segmentation).  A character without a piece is spelt
in byte pieces.

Decoding joins the pieces, with U+2581 read as a space, and drops the space put before every text, so every
text comes back as it was (byte pieces keep U+2581 itself and anything else).

Definitions for unusual input: null counts as empty; an empty text is the single space piece and decodes to
the empty text; a null doc_id has a key of its own; repeated rows get equal ids; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _PI, U64, _power, mix, prepare, string_buffers, text_blocks, unit
from .tokens import _Table

_ALONE = np.zeros(256, bool)
_ALONE[[9, 10, 11, 12, 13]] = True


class Vocabulary:
    """Pieces as bytes; ``weight`` is their log weight."""

    def __init__(self, pieces: list[bytes | None], rank: np.ndarray, byte_ids: np.ndarray, alpha: float):
        self.bytes = [p if p is not None else b"" for p in pieces]
        self.byte_ids = byte_ids
        self.len = np.asarray([len(p) for p in self.bytes], np.int64)
        self.off = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        for b, i in enumerate(byte_ids.tolist()):
            self.bytes[i] = bytes([b])
        self.out_len = np.asarray([len(p) for p in self.bytes], np.int64)
        self.out_off = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.weight = -alpha * np.log(rank + 2.7)
        self.fallback = float(-alpha * np.log(4 * rank.max() + 2.7))
        ids = np.flatnonzero(self.len > 0)
        self.longest = int(self.len.max())
        self.table = _Table(int(4 * len(ids)).bit_length())
        self.table_ids = ids
        start = self.off[ids]
        self.table.add(_hash_ranges(self.flat, start, start + self.len[ids]), 0)
        # (length, first two bytes) of pieces: few places need a look-up
        self.lengths = []
        for n in np.unique(self.len[ids]).tolist():
            may = np.zeros(65536, bool)
            for i in ids[self.len[ids] == n].tolist():
                p = self.bytes[i]
                if n == 1:
                    may[p[0] * 256 : p[0] * 256 + 256] = True
                else:
                    may[p[0] * 256 + p[1]] = True
            self.lengths.append((n, may))

    @classmethod
    def load(cls, path: str, alpha: float) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces: list[bytes | None] = [None] * n
        rank, byte_ids = np.zeros(n), np.zeros(256, np.int64)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)) and "▁" not in p[1:]:
                pieces[i] = p.replace("▁", " ").encode()
                rank[i] = -sp.get_score(i)
        return cls(pieces, rank, byte_ids, alpha)


def _hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    with np.errstate(over="ignore"):
        if sums is None:
            sums = _prefix(raw)
        h = mix((sums[end] - sums[start]) * _power(_PI, len(raw) + 1)[start] ^ (end - start).astype(U64))
    h[h == 0] = U64(1)
    return h


def _prefix(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(U64) + U64(1)) * _power(_P, len(raw)), out=sums[1:])
    return sums


class Lattice:
    """Forward-filtered lattices of distinct chunks laid end to end in ``raw``.

    Places (one past a byte of a chunk) are numbered by their distance from the chunk's start, so that all
    chunks advance together; the edges (pieces that end there) of a place follow each other, longest first.
    """

    def __init__(self, v: Vocabulary, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        n, size = len(raw), end - start
        chunk = np.repeat(np.arange(len(start)), size)
        at_in = np.arange(n) - start[chunk]
        order = np.argsort(-size, kind="stable")
        turn = np.empty(len(size), np.int64)
        turn[order] = np.arange(len(size))
        steps = int(size.max())
        live = np.searchsorted(-size[order], -np.arange(steps), "left")
        base = np.concatenate([[0], np.cumsum(live)])
        #: number of the place after each byte
        self.number = base[at_in] + turn[chunk]
        # edges by length: where they start, and their ids
        left = size[chunk] - at_in
        first = (raw & 0xC0) != 0x80
        width = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
        pair = raw.astype(np.int64) * 256
        pair[:-1] += raw[1:]
        sums = _prefix(raw)
        whole = np.zeros(n, bool)  # a piece is the very character that starts here
        parts = []
        for length, may in reversed(v.lengths):
            at = np.flatnonzero(may[pair])
            at = at[(left[at] >= length) & first[at]]
            if len(at):
                got = v.table.find(_hash_ranges(raw, at, at + length, sums))
                at, got = at[got >= 0], v.table_ids[got[got >= 0]]
                whole[at[width[at] == length]] = True
                parts.append((at, np.full(len(at), length), got, v.weight[got]))
        spelt = np.flatnonzero(first & ~whole)
        char = np.minimum(width[spelt], left[spelt])
        parts.append((spelt, char, np.full(len(spelt), -1), v.fallback * char))
        dest = [self.number[at + k - 1] for at, k, _, _ in parts]
        count = np.bincount(np.concatenate(dest), minlength=n)
        bare = np.flatnonzero(count == 0)  # inside a character
        count[bare] = 1
        edge = np.cumsum(count) - count
        self.edge = edge
        total = int(count.sum())
        ids, back, weight = np.full(total, -2, np.int32), np.zeros(total, np.int32), np.full(total, -np.inf)
        origin = np.full(total, n, np.int64)  # n: the start of a chunk
        fill = edge.copy()
        for (at, k, i, w), d in zip(parts, dest, strict=True):
            e = fill[d]
            fill[d] += 1
            ids[e], back[e], weight[e] = i, k, w
            inner = at_in[at] > 0
            origin[e[inner]] = self.number[at[inner] - 1]
        alpha = np.full(n + 1, -np.inf)
        alpha[n] = 0.0
        stop = np.append(edge, total)
        reach = np.empty(total)
        with np.errstate(divide="ignore", invalid="ignore"):
            for s in range(steps):
                lo, hi = base[s], base[s + 1]
                a, z = stop[lo], stop[hi]
                t = weight[a:z] + alpha[origin[a:z]]
                reach[a:z] = t
                cuts = edge[lo:hi] - a
                top = np.maximum.reduceat(t, cuts)
                top[~np.isfinite(top)] = 0.0
                alpha[lo:hi] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, count[lo:hi])), cuts))
            post = np.exp(reach - np.repeat(alpha[:n], count))
        post[~np.isfinite(post)] = 0.0
        run = np.cumsum(post)
        self.cum = run - np.repeat(run[edge] - post[edge], count)
        self.cum[edge + count - 1] = 2.0
        # the last edge of a place that can be drawn
        can = np.flatnonzero(post > 0)
        owner = np.repeat(np.arange(n), count)[can]
        last = np.zeros(n, np.int64)
        last[owner] = can
        self.last = last
        self.ids, self.back = ids, back

    def pick(self, place: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece id or -1, its length) drawn at each place, given as the byte before it."""
        number = self.number[place - 1]
        e = self.edge[number]
        more = np.flatnonzero(self.cum[e] <= u)
        while len(more):
            e[more] += 1
            more = more[self.cum[e[more]] <= u[more]]
        e = np.minimum(e, self.last[number])
        return self.ids[e], self.back[e]


def sample_block(v: Vocabulary, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts (each already begins with its extra space), and how many each has."""
    n = len(raw)
    cut = (raw == 32) | _ALONE[raw]
    cut[1:] |= _ALONE[raw[:-1]]
    cut[offsets[:-1]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    h = _hash_ranges(raw, start, end)
    _, where, chunk = np.unique(h, return_index=True, return_inverse=True)
    size = (end - start)[where]
    ends = np.cumsum(size)
    own = raw[np.repeat(start[where] - (ends - size), size) + np.arange(int(ends[-1]))]
    lattice = Lattice(v, own, ends - size, ends)
    doc = np.searchsorted(offsets, start, "right") - 1
    with np.errstate(over="ignore"):
        row = mix(keys.astype(np.int64).view(U64) + mix(np.asarray([seed], U64))[0])
    out = np.full(n, -1, np.int32)
    shift = start - (ends - size)[chunk]  # place in the chunk's lattice + shift = place in the block
    at, low = ends[chunk].copy(), (ends - size)[chunk]
    live = np.arange(len(start))
    while len(live):
        place = at[live]
        here = place + shift[live]
        with np.errstate(over="ignore"):
            u = unit(mix(row[doc[live]] ^ mix((here - offsets[doc[live]]).astype(U64))))
        ids, back = lattice.pick(place, u)
        begin = here - back
        piece = ids >= 0
        out[begin[piece]] = ids[piece]
        if not piece.all():
            b, k = begin[~piece], back[~piece]
            for j in range(int(k.max())):
                some = b[k > j] + j
                out[some] = v.byte_ids[raw[some]]
        at[live] = place - back
        live = live[at[live] > low[live]]
    keep = out >= 0
    counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])
    return out[keep].astype(np.uint32), counts


_open: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _open:
        _open[path, alpha] = Vocabulary.load(path, alpha)
    return _open[path, alpha]


def encode(docs: DataFrame, model_path: str, alpha: float = 1.5, seed: int = 1) -> DataFrame:
    """doc_id, text, ids: one sampled segmentation per document, as little-endian uint32 bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path, alpha)
        for b in batches:
            raw, offsets = string_buffers(b.column("text"))
            keys = np.asarray(b.column("doc_id").fill_null(-1))
            for lo, hi in text_blocks(offsets):
                part = raw[offsets[lo] : offsets[hi]]
                off = offsets[lo : hi + 1] - offsets[lo]
                ids, counts = sample_block(v, np.insert(part, off[:-1], 32), off + np.arange(hi - lo + 1), keys[lo:hi], seed)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                frames = [data[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo), pa.array(frames, pa.binary())],
                    names=["doc_id", "text", "ids"],
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids: joined pieces without the first space."""
    n = v.out_len[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b""
    return v.out[np.repeat(v.out_off[ids] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes()[1:]


def decode(encoded: DataFrame, model_path: str, alpha: float = 1.5) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``."""
    prepare(encoded.sparkSession)
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path, alpha)
        for b in batches:
            texts = [decode_ids(v, np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in b.column("ids").to_pylist()]
            decoded = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
