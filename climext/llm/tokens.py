"""Exact encoding with a public word-level byte-pair vocabulary, vectorised.

The vocabulary lower-cases a text, drops white space, cuts it into pieces
(letters, single digits, runs of other signs, English contractions) and encodes
each piece by itself.  The pieces of a whole block of texts are found with array
operations and looked up by a 64-bit hash in a table that every Python worker
fills as it meets new pieces; only new pieces go through the tokenizer's merges.
Texts holding characters on which array code and tokenizer might differ (or that
spell a special token) are given to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import _P, _PI, U64, _power, mix, string_buffers, text_blocks

# bytes: 0 white space, 1 letters (ASCII and two-byte Latin letters), 2 digits, 3 other signs
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[128:] = 1
#: No other characters reach the array code: ASCII but controls, and Latin letters whose case is plain.
ODD = r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]|<\|"
_AFTER = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class _Table:
    """Open-addressed table from 64-bit hashes to numbers."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, U64((1 << bits) - 1)
        self.keys, self.vals, self.n = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 where absent."""
        pos = h & self.mask
        key = self.keys[pos]
        out = np.where(key == h, self.vals[pos], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            pos[rest] = (pos[rest] + U64(1)) & self.mask
            key = self.keys[pos[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.vals[pos[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        keys, vals, mask = self.keys, self.vals, int(self.mask)
        for i, h in enumerate(hashes.tolist()):
            p = h & mask
            while keys[p]:
                p = (p + 1) & mask
            keys[p], vals[p] = h, first + i
        self.n += len(hashes)


class WordEncoder:
    """Ids of whole batches of texts; ``most`` bounds the kept pieces (the table restarts when full)."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = {chr(k): v for k, v in _byte_letters().items()}
        self.letters = str.maketrans(self.letters)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.table = _Table(int(2 * self.most).bit_length())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 16, np.int64)  # of piece i in flat
        self.len = np.zeros(1 << 16, np.int32)
        self.pieces = self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids = [[t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.letters))] for w in words]
        total = sum(map(len, ids))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.pieces + len(ids) > len(self.off):
            self.off, self.len = np.concatenate([self.off, self.off]), np.concatenate([self.len, self.len])
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        at = slice(self.pieces, self.pieces + len(ids))
        self.len[at], self.off[at] = lens, self.used + np.cumsum(lens) - lens
        self.table.add(hashes, self.pieces)
        self.pieces += len(ids)
        self.used += total

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their number in each text."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind = _CLASS[raw]
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edges = offsets[1:-1]
        cut[edges[edges < n]] = True
        self._contractions(raw, kind, cut, offsets)
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        keep = kind[start] != 0
        start, end = start[keep], end[keep]
        h = _range_hashes(raw, start, end)
        if self.pieces > self.most:
            self._clear()
        at = self.table.find(h)
        if len(miss := np.flatnonzero(at < 0)):
            fresh, first = np.unique(h[miss], return_index=True)
            where = miss[first]
            data = raw.tobytes()
            s, e = start[where].tolist(), end[where].tolist()
            if self.pieces + len(fresh) > self.table.mask // 2:
                self._grow()
            self._learn(fresh, [data[i:j] for i, j in zip(s, e, strict=True)])
            at[miss] = self.table.find(h[miss])
        lens = self.len[at].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.off[at] - (ends - lens), lens) + np.arange(total)]
        firsts = np.searchsorted(start, offsets)  # number of the first piece of each text
        sums = np.concatenate([[0], ends])
        return ids, np.diff(sums[firsts])

    def _grow(self) -> None:
        old = self.table
        self.table = _Table(old.bits + 2)
        order = np.argsort(old.vals[old.keys != 0], kind="stable")
        self.table.add(old.keys[old.keys != 0][order], 0)

    @staticmethod
    def _contractions(raw, kind, cut, offsets) -> None:
        """'s 't 're 've 'm 'll 'd where the sign stands alone: one piece, and a new one after it."""
        n = len(raw)
        at = np.flatnonzero((raw[:-1] == 39) & cut[:-1] & (kind[1:] == 1) & cut[1:])
        if not len(at):
            return
        stop = offsets[np.searchsorted(offsets, at, "right")]
        done = np.zeros(len(at), bool)
        for tail in _AFTER:
            k = len(tail)
            ok = ~done & (at + k < stop)
            for j in range(k):
                ok[ok] = raw[at[ok] + 1 + j] == tail[j]
            p = at[ok]
            cut[p + 1] = False
            q = p + 1 + k
            cut[q[q < n]] = True
            done |= ok

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (null: none)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, ODD))
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts))
        raw, offsets = string_buffers(plain)
        ids, counts = [], []
        for lo, hi in text_blocks(offsets):
            a, c = self._block(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ids.append(a)
            counts.append(c)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if odd.any():
            firsts = np.concatenate([[0], np.cumsum(counts)])
            parts = []
            for i in range(len(texts)):
                if odd[i]:
                    x = self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids
                    parts.append(np.asarray(x, np.uint32))
                    counts[i] = len(x)
                else:
                    parts.append(flat[firsts[i] : firsts[i + 1]])
            flat = np.concatenate(parts)
        return flat, counts


def _range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * _power(_P, n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power(_PI, n + 1)[start]
        h = mix(h ^ (end - start).astype(U64))
    h[h == 0] = U64(1)
    return h


_open: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]
