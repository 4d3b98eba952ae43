"""Document quality from a linear-chain conditional random field over lines.

Each line gets binned features (letters, case, signs, repetition, length) and those of the lines before and
after it.  The field has two labels, bad and good, and weights for features and for pairs of neighbouring
labels; it is trained on documents whose lines all carry the document's label.  A document's score is the
mean of its lines' forward-backward marginals of "good", weighted by their length.

Definitions for unusual input: a null text counts as empty, an empty text is one empty line with weight one, so
it has a score like any other; lines end at line feeds; repeated rows get equal scores; without usable
labels every score is 0.5; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, SPACE, U64, Tokens, long_word_hash, mix, prepare, string_buffers, text_blocks, word_pieces
from .labels import held_out, training_rows

#: Bins of a feature; one more stands for "no such line".
BINS = 10
FEATURES = 14


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_UPPER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _table(b"abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC3:0xF5] = 1  # first bytes of other characters
_DIGIT, _BANG, _BAR = _table(b"0123456789"), _table(b"!"), _table(b"|")
_SIGN, _STOP = _table(b"#$%&*@^~=<>{}[]\\/_+`"), _table(b".,;:?")
_CLASSES = (_UPPER, _LETTER, _DIGIT, _BANG, _BAR, _SIGN, _STOP)
_EDGES = np.asarray([0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.45, 0.7, 0.9])


class Lines(NamedTuple):
    doc: np.ndarray
    weight: np.ndarray
    bins: np.ndarray  # lines x FEATURES, uint8


def line_features(raw: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> Lines:
    """Features of every line of a block of texts; every text has one line at least.

    Bytes and words are looked into piece by piece; what stays is about 100 bytes a line.
    """
    breaks = np.flatnonzero(raw == 10)
    # a line starts with each document and after each line feed; one after the last byte is an empty line
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    del breaks, order
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.append(starts[1:], 0) - 1
    ends[last] = offsets[doc[last] + 1]
    lines = len(starts)
    upper, letters, digits, bangs, bars, signs, stops = counts = [np.zeros(lines, np.int32) for _ in _CLASSES]
    words, repeats, repeats2, longest = (np.zeros(lines, np.int32) for _ in range(4))
    digest = np.zeros(lines, U64)
    tail_hash, tail_line = np.zeros(0, U64), np.zeros(0, np.int64)  # the two words before a piece
    for a in range(0, len(raw), piece):
        z = min(a + piece, len(raw))
        part = raw[a:z]
        l0, l1 = int(np.searchsorted(ends, a, "left")), int(np.searchsorted(starts, z, "right"))
        lo, hi = np.clip(starts[l0:l1], a, z) - a, np.clip(ends[l0:l1], a, z) - a
        sums = np.zeros(len(part) + 1, np.int32)
        for table, out in zip(_CLASSES, counts, strict=True):
            np.cumsum(table[part], out=sums[1:])
            out[l0:l1] += sums[hi] - sums[lo]
        before = np.append(raw[a - 1] if a else 0, part[:-1])
        accented = (before == 0xC3) & (part < 0x9F)
        np.cumsum(accented, out=sums[1:])
        upper[l0:l1] += sums[hi] - sums[lo]
    for a, z, edges, one_word in word_pieces(raw, offsets, piece):
        part = raw[a:z]
        l0, l1 = int(np.searchsorted(ends, a, "left")), int(np.searchsorted(starts, z, "right"))
        if one_word:
            first, end, h = np.zeros(1, np.int64), np.asarray([len(part)]), long_word_hash(part)
        else:
            t = Tokens(part, edges, ~SPACE)
            first, end, h = t.start, t.end, t.hash
        if not len(first):
            continue
        line = l0 + np.searchsorted(starts[l0:l1], first + a, "right") - 1
        k = len(tail_hash)
        h2, line2 = np.concatenate([tail_hash, h]), np.concatenate([tail_line, line])
        for gap, out in ((1, repeats), (2, repeats2)):
            again = np.flatnonzero((h2[gap:] == h2[:-gap]) & (line2[gap:] == line2[:-gap])) + gap
            np.add.at(out, line2[again[again >= k]], 1)
        tail_hash, tail_line = h2[-2:], line2[-2:]
        np.maximum.at(longest, line, (end - first).astype(np.int32))
        begins = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        here, n_here = line[begins], np.diff(np.append(begins, len(line)))
        place = np.arange(len(line)) - np.repeat(begins - words[here], n_here)
        with np.errstate(over="ignore"):
            digest[here] += np.add.reduceat(mix(h ^ mix(place.astype(U64))), begins)
        words[here] += n_here.astype(np.int32)
    same = np.lexsort((digest, doc))
    digest = digest[same]
    twin = np.zeros(lines, bool)
    twin[same[1:]] = (digest[1:] == digest[:-1]) & (doc[same][1:] == doc[same][:-1]) & (words[same[1:]] > 0)
    n = ends - starts
    some, any_letters, any_words = np.maximum(n, 1), np.maximum(letters, 1), np.maximum(words, 1)
    tail = np.zeros(lines, np.uint8)
    full = np.flatnonzero(n > 0)
    final = raw[ends[full] - 1]
    tail[full] = 1 + _STOP[final] + 2 * _BANG[final] + 3 * _SIGN[final]
    bins = np.empty((lines, FEATURES), np.uint8)
    shares = (
        (upper, any_letters), (letters, some), (digits, some), (bangs, any_words), (bars, any_words), (signs, any_words),
        (stops, any_words), (repeats, any_words), (repeats2, any_words),
    )
    for f, (x, of) in enumerate(shares):
        bins[:, f] = np.minimum(np.searchsorted(_EDGES, x / of, "left"), BINS - 1)
    bins[:, 9] = np.minimum(longest // 4, BINS - 1)
    bins[:, 10] = np.minimum(np.log2(some), BINS - 1)
    bins[:, 11] = np.minimum(np.log2(any_words), BINS - 1)
    bins[:, 12] = twin
    bins[:, 13] = tail
    return Lines(doc, n + 1.0, bins)


def node_scores(x: Lines, weights: np.ndarray) -> np.ndarray:
    """Score of good over bad of each line, added up feature by feature."""
    own, before, after = weights.reshape(3, FEATURES, BINS + 1)
    node, left, right = (np.zeros(len(x.doc)) for _ in range(3))
    for f in range(FEATURES):
        b = x.bins[:, f]
        node += own[f][b]
        left += before[f][b]
        right += after[f][b]
    first = np.append(True, x.doc[1:] != x.doc[:-1])
    node += np.where(first, before[:, BINS].sum(), np.append(0.0, left[:-1]))
    return node + np.where(np.append(first[1:], True), after[:, BINS].sum(), np.append(right[1:], 0.0))


def active_features(x: Lines) -> np.ndarray:
    """Numbers of the features that hold for each line: own, those of the line before, those of the line after."""
    own = x.bins.astype(np.int64) + np.arange(FEATURES) * (BINS + 1)
    width = FEATURES * (BINS + 1)
    none = BINS + np.arange(FEATURES) * (BINS + 1)
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.append(True, x.doc[1:] != x.doc[:-1])
    before[first] = none
    after[np.append(first[1:], True)] = none
    return np.concatenate([own, before + width, after + 2 * width], axis=1)


N_WEIGHTS = 3 * FEATURES * (BINS + 1)


#: Lines that a chain advances one by one; longer chains are cut into segments that advance together.
SEGMENT = 512


def _step(v0: np.ndarray, v1: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of (exp v) times (exp m), for rows v = (v0, v1) and 2x2 matrices m."""
    return np.logaddexp(v0 + m[..., 0, 0], v1 + m[..., 1, 0]), np.logaddexp(v0 + m[..., 0, 1], v1 + m[..., 1, 1])


class Chains:
    """Documents laid out so that all chains, and all segments of long ones, advance together."""

    def __init__(self, doc: np.ndarray, segment: int = SEGMENT):
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(doc)))
        parts = -(-length // segment)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(start, parts) + nth * segment
        size = np.minimum(segment, np.repeat(start + length, parts) - begin)
        order = np.argsort(-size, kind="stable")
        self.start, self.nth, self.many = start, nth, np.repeat(parts, parts) > 1
        self.order, self.begin, self.size = order, begin, size
        live = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), "left")
        self.at = [begin[order[:n]] + i for i, n in enumerate(live.tolist())]  # lines at step i

    def _borders(self, node: np.ndarray, edge: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward scores before each segment and backward scores after it, from the segments' transfer matrices."""
        enter, leave = np.zeros((len(self.nth), 2)), np.zeros((len(self.nth), 2))
        some = self.order[self.many[self.order]]  # segments of long chains, longest first
        if not len(some):
            return enter, leave
        move = np.empty((len(self.nth), 2, 2))
        move[some] = into[some]
        move[some, :, 1] += node[self.begin[some], None]
        for i in range(1, int(self.size[some[0]])):
            live = some[: int(np.searchsorted(-self.size[some], -i, "left"))]
            m = move[live]
            for y in (0, 1):
                move[live, y, 0], move[live, y, 1] = _step(m[:, y, 0], m[:, y, 1], edge)
            move[live, :, 1] += node[self.begin[live] + i, None]
        inner = np.flatnonzero(self.many & (self.nth > 0))
        inner = inner[np.argsort(self.nth[inner], kind="stable")]
        rounds = np.split(inner, np.flatnonzero(np.diff(self.nth[inner])) + 1)
        for s in rounds:
            enter[s, 0], enter[s, 1] = _step(enter[s - 1, 0], enter[s - 1, 1], move[s - 1])
        for s in reversed(rounds):
            leave[s - 1, 0], leave[s - 1, 1] = _step(leave[s, 0], leave[s, 1], np.swapaxes(move[s], 1, 2))
        return enter, leave

    def marginals(self, node: np.ndarray, edge: np.ndarray):
        """P(good) of each line, expected counts of label pairs, and the log partition sum over all chains.

        ``node``: score of good over bad for each line; ``edge``: 2x2 scores of neighbouring labels.
        """
        n = len(node)
        # a chain starts from either label with half the weight
        into = np.where((self.nth == 0)[:, None, None], -np.log(2.0), edge[None])
        enter, leave = self._borders(node, edge, into)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for i, at in enumerate(self.at):
            if i == 0:
                e = enter[self.order]
                a[at, 0], a[at, 1] = _step(e[:, 0], e[:, 1], into[self.order])
            else:
                p = a[at - 1]
                a[at, 0], a[at, 1] = _step(p[:, 0], p[:, 1], edge)
            a[at, 1] += node[at]
        b[self.begin + self.size - 1] = leave
        for i in range(len(self.at) - 2, -1, -1):
            nxt = self.at[i + 1]
            at = nxt - 1
            b[at, 0], b[at, 1] = _step(b[nxt, 0], b[nxt, 1] + node[nxt], edge.T)
        z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
        good = np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0))
        pairs = np.zeros((2, 2))
        inner = np.ones(n, bool)
        inner[self.start] = False
        to = np.flatnonzero(inner)
        for y in (0, 1):
            for w in (0, 1):
                pairs[y, w] = np.exp(a[to - 1, y] + edge[y, w] + w * node[to] + b[to, w] - z[to]).sum()
        return good, pairs, float(z[self.start].sum())


class Model(NamedTuple):
    weights: np.ndarray
    edge: np.ndarray


def fit(features: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample; ``y`` is each line's label."""
    w, edge = np.zeros(N_WEIGHTS), np.zeros((2, 2))
    if not len(y):
        return Model(w, edge)
    chains = Chains(doc)
    docs = len(chains.start)
    flat = features.ravel()
    each = features.shape[1]
    seen = np.bincount(flat, np.repeat(y, each).astype(float), N_WEIGHTS)
    inner = np.append(False, doc[1:] == doc[:-1])
    pairs = np.zeros((2, 2))
    to = np.flatnonzero(inner)
    np.add.at(pairs, (y[to - 1], y[to]), 1)
    m, v = np.zeros(N_WEIGHTS + 4), np.zeros(N_WEIGHTS + 4)
    for i in range(1, steps + 1):
        good, expected, _ = chains.marginals(w[features].sum(axis=1), edge)
        gw = (seen - np.bincount(flat, np.repeat(good, each), N_WEIGHTS)) / docs - ridge * w
        ge = (pairs - expected) / docs - ridge * edge
        g = np.concatenate([gw, ge.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, edge = w + step[:N_WEIGHTS], edge + step[N_WEIGHTS:].reshape(2, 2)
    return Model(w, edge)


def _blocks(texts: pa.Array):
    raw, offsets = string_buffers(texts)
    for lo, hi in text_blocks(offsets, PIECE):
        yield lo, hi, line_features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_lines: int = 500) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out third, of at most ``sample_lines`` lines each."""
    prepare(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in _blocks(b.column("text")):
                bins = x.bins
                cuts = np.searchsorted(x.doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo),
                        b.column("y").slice(lo, hi - lo),
                        pa.array([bins[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "y", "bins"],
                )

    rows = (
        training_rows(docs, labels, "quality", sample)
        .where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < sample_lines)
        .select("doc_id", "y", "text")
        .mapInArrow(extract, "doc_id long, y int, bins binary")
        .toPandas()
        .sort_values("doc_id")
    )
    if not len(rows):
        return Model(np.zeros(N_WEIGHTS), np.zeros((2, 2)))
    bins = [np.frombuffer(x, np.uint8).reshape(-1, FEATURES) for x in rows["bins"]]
    doc = np.repeat(np.arange(len(bins)), [len(x) for x in bins])
    lines = Lines(doc, np.ones(len(doc)), np.concatenate(bins))
    return fit(active_features(lines), doc, np.repeat(rows["y"].to_numpy(np.int64), [len(x) for x in bins]))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in ``column`` (replacing one of that name)."""
    prepare(docs.sparkSession)
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0)]
            for _, _, x in _blocks(b.column("text").cast(pa.string())):
                good, _, _ = Chains(x.doc).marginals(node_scores(x, model.weights), model.edge)
                out.append(np.bincount(x.doc, good * x.weight) / np.bincount(x.doc, x.weight))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], names=[*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
