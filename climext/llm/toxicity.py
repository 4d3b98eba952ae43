"""Toxicity of texts after undoing leetspeak, spacing and repetition.

Noisy channel: a character language model (four letters, interpolated, counted over the whole corpus) says
what was meant; the channel says how letters get written (as themselves, as look-alike signs, repeated,
with separators between).  Every spelling that leaves a choice becomes a lattice of characters, and Viterbi
finds its best reading; a spelling whose lattice is a single path reads as it stands.  A logistic
regression over the words of the restored text, and over their beginnings, gives the score.

White space is a separator too: one-character tokens in a row share a lattice, and so do up to six short tokens that
together read as a word that counts ("stu pid"); where the model prefers them apart, they stay apart.

Definitions for unusual input: null counts as empty; a text without words gets the model's base score;
repeated rows get equal scores; without usable labels of both kinds the score is the share of toxic labels (0 if
there are none); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, SPACE, Tokens, materialize, prepare, string_buffers, text_blocks
from .labels import held_out, training_rows

# ---------------------------------------------------------------- alphabet

A = 27  # 0 is the edge of a word, 1-26 are letters
_FOLD = {
    **dict.fromkeys("àáâãäåāăą", "a"), **dict.fromkeys("çćĉċč", "c"), **dict.fromkeys("èéêëēĕėęě", "e"),
    **dict.fromkeys("ìíîïĩīĭį", "i"), **dict.fromkeys("ñńņň", "n"), **dict.fromkeys("òóôõöøōŏő", "o"),
    **dict.fromkeys("ùúûüũūŭůűų", "u"), **dict.fromkeys("ýÿŷ", "y"), **dict.fromkeys("śŝşš", "s"),
    **dict.fromkeys("źżž", "z"), "ß": "s", "ð": "d", "ğ": "g", "ł": "l",
}
LETTERS = {chr(97 + i): i + 1 for i in range(26)} | {k: ord(v) - 96 for k, v in _FOLD.items()}
#: Look-alikes and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
SEPARATORS = frozenset(" \t\n.-_*~'·,")
_SEPARATOR = np.array([chr(i) in SEPARATORS and i < 128 for i in range(256)])
_LEET_COST, _REPEAT_COST, _JOIN_COST, _BREAK_COST = 1.5, 0.7, 0.3, 2.0

_ASCII = np.zeros(256, np.int8)
for _c, _s in LETTERS.items():
    if _c < "\x80":
        _ASCII[ord(_c)] = _s
_C3 = np.zeros(256, np.int8)
for _c, _s in LETTERS.items():
    if len(_b := _c.encode()) == 2 and _b[0] == 0xC3:
        _C3[_b[1]] = _s


def symbols(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letters of a block of lower-cased texts; words apart by single edges."""
    s = _ASCII[raw]
    lead = raw == 0xC3
    if len(raw):
        second = np.append(False, lead[:-1])
        s[second] = _C3[raw[second]]
    keep = ~lead
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    # an edge symbol before each text
    s = np.insert(s[keep], np.cumsum(keep)[offsets[(offsets > 0) & (offsets < len(raw))] - 1], 0)
    s = np.concatenate([[0], s, [0]])
    return s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))].astype(np.int64)


def context_codes(s: np.ndarray) -> np.ndarray:
    """For every symbol after the first: its code with the three before it, within its word."""
    a = s[:-1]
    b = np.where(a != 0, np.append(0, s[:-2]), 0)
    c = np.where(b != 0, np.append([0, 0], s[:-3])[: len(a)], 0)
    return ((c * A + b) * A + a) * A + s[1:]


def _blocks(texts: pa.Array):
    raw, offsets = string_buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    for lo, hi in text_blocks(offsets, PIECE):
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def count_characters(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows three others, over all texts; A**4 numbers whatever the input."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**4, np.int64)
        for b in batches:
            for lo, hi, raw, offsets in _blocks(b.column("text")):
                parts = _parts(raw) if hi - lo == 1 else [(0, len(raw))]
                for a, z in parts:
                    edges = offsets if hi - lo > 1 else np.asarray([0, z - a])
                    total += np.bincount(context_codes(symbols(raw[a:z], edges)), minlength=A**4)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code])], names=["code", "n"])

    rows = (
        docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .mapInArrow(run, "code int, n long")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(A**4, np.int64)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before), A**3 x A, interpolated over shorter contexts by Witten and Bell."""
    c4 = counts.reshape(A, A, A, A).astype(np.float64)
    levels = [c4.sum(axis=(0, 1, 2))[None], c4.sum(axis=(0, 1)), c4.sum(axis=0).reshape(A * A, A), c4.reshape(A**3, A)]
    p = np.full((1, A), 1 / A)
    for c in levels:
        kinds, total = (c > 0).sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
        lower = np.tile(p, (len(c) // len(p), 1))
        p = (c + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))
    return np.log(p).astype(np.float32)


# ---------------------------------------------------------------- decoding

_TRIM_L, _TRIM_R = "\"'.,;:?()[]{}<>#%&*-_=/\\~`“”’‘…–—", "\"'.,;:?!)[]{}<>#%&*|-_=/\\~`“”’‘…–—"
_DECOR = re.compile(r"([^\w\s])\1{2,}$")
#: Characters that leave a choice wherever they stand, and letters that may be a repetition (after folding).
_CHOICE = re.compile("[" + re.escape("".join(sorted({*LEET, *SEPARATORS}))) + "]")
_DOUBLE = re.compile(r"([a-z])\1")


class _Folded(dict):
    """For str.translate: letters as they read, everything else as a space."""

    def __missing__(self, code: int) -> str:
        s = LETTERS.get(chr(code))
        self[code] = out = chr(96 + s) if s else " "
        return out


_FOLDED = _Folded()


def _spelled(path) -> str:
    letters = []
    while path is not None:
        letters.append(chr(96 + path[0]) if path[0] else " ")
        path = path[1]
    return "".join(reversed(letters))


class Decoder:
    """Best readings of spellings under a language model, kept for each spelling."""

    def __init__(self, lm: np.ndarray, most: int = 300_000):
        self.lm = lm.reshape(-1).tolist()
        self.most, self.kept = most, {}

    def options(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """For each character: (symbol, or -1 for none; cost)."""
        before = frozenset()
        for ch in text:
            s = LETTERS.get(ch)
            if s is not None:
                o, now = [(s, 0.0)], frozenset((s,))
            elif ch in LEET:
                now = frozenset(LETTERS[x] for x in LEET[ch])
                o = [*((x, _LEET_COST) for x in sorted(now)), (0, _BREAK_COST)]
            elif ch in SEPARATORS:
                o, now = [(0, 0.0), (-1, _JOIN_COST)], frozenset()
            else:
                o, now = [(0, 0.0)], frozenset()
            if now & before:  # may repeat the letter before
                o.append((-1, _REPEAT_COST))
            yield o
            before = now

    def viterbi(self, lattice: Iterable[list[tuple[int, float]]], most: int = 2048) -> list[str]:
        """Words of the best path.

        Where a single state is left, the way to it is settled and written down.  If that happens nowhere within
        ``most`` to twice as many characters, the best state so far is taken, so that memory is bounded.
        """
        lm = self.lm
        states = {0: (0.0, None)}  # three symbols before -> score and the path (symbol, rest)
        settled: list[str] = []
        steps = 0
        for options in chain(lattice, ([(0, 0.0)],)):
            new: dict[int, tuple] = {}
            for context, (score, path) in states.items():
                for s, cost in options:
                    if s < 0:
                        to, value, way = context, score - cost, path
                    elif s == 0:
                        # several edges in a row count as one
                        value = score - cost + (lm[context * A] if context else 0.0)
                        to, way = 0, path if context == 0 else (0, path)
                    else:
                        to = (context % (A * A)) * A + s
                        value, way = score - cost + lm[context * A + s], (s, path)
                    old = new.get(to)
                    if old is None or value > old[0]:
                        new[to] = (value, way)
            states = new
            steps += 1
            if steps >= most and (len(states) == 1 or steps >= 2 * most):
                context = max(states, key=lambda c: (states[c][0], -c))
                score, path = states[context]
                settled.append(_spelled(path))
                states, steps = {context: (score, None)}, 0
        settled.append(_spelled(states[0][1]))
        return "".join(settled).split()

    def words(self, spelling: str) -> tuple[str, ...]:
        """The words that one token (or spaced-out run of tokens) reads as."""
        got = self.kept.get(spelling)
        if got is None:
            core = _DECOR.sub("", spelling).rstrip(_TRIM_R).lstrip(_TRIM_L)
            folded = core.translate(_FOLDED)
            if not folded.strip():
                return (core,) if core else ()
            if not (_CHOICE.search(core) or _DOUBLE.search(folded)):
                return tuple(folded.split())
            got = tuple(self.viterbi(self.options(core)))
            if len(spelling) <= _KEPT:
                if len(self.kept) > self.most:
                    self.kept.clear()
                self.kept[spelling] = got
        return got

    def restored(self, texts: pa.Array, joined: np.ndarray | None = None, wanted: Wanted | None = None) -> Iterator[set[str]]:
        """The set of words of each restored text.

        White space is a separator like any other where tokens are short: runs of three or more one-character tokens, and
        runs that ``joined`` names: the hashes (:func:`word_hash`) of words that two to six tokens may make together
        (none: every run of short tokens).  The lattice of such a run leaves open whether its tokens are words or parts
        of one.

        With ``wanted``, only wanted words, and tokens that can't yield one are not looked into.
        """
        for lo, hi, raw, offsets in _blocks(texts):
            if hi - lo == 1 and len(raw) > PIECE:
                found: set[str] = set()
                for a, z in _parts(raw):
                    found |= self._words_of(raw[a:z], np.asarray([0, z - a]), joined, wanted)[0]
                yield found
            else:
                yield from self._words_of(raw, offsets, joined, wanted)

    def _words_of(self, raw: np.ndarray, offsets: np.ndarray, joined, wanted) -> list[set[str]]:
        t = Tokens(raw, offsets, ~SPACE, hashes=False)
        spans = _spaced_runs(raw, t, joined)
        data = raw.tobytes()
        look = np.arange(len(t.start)) if wanted is None else np.flatnonzero(wanted.may_be(raw, t))
        cuts = np.searchsorted(t.doc[look], np.arange(len(offsets)))
        start, end = t.start[look].tolist(), t.end[look].tolist()
        out = []
        for d in range(len(offsets) - 1):
            found: set[str] = set()
            here = range(int(cuts[d]), int(cuts[d + 1]))
            spellings = {data[start[i] : end[i]] for i in here}
            if wanted is not None:
                spellings -= wanted.dull
            for x in spellings:
                # other white space than the six signs
                words = [w for y in x.decode("utf-8", "replace").split() for w in self.words(y)]
                if wanted is not None:
                    words = [w for w in words if wanted.has(w)]
                    if not words and len(x) <= _KEPT:
                        wanted.dull.add(x)
                found.update(words)
            for a, z in spans.get(d, ()):
                words = self.words(data[a:z].decode("utf-8", "replace"))
                found.update(words if wanted is None else [w for w in words if wanted.has(w)])
            if wanted is not None and len(wanted.dull) > self.most:
                wanted.dull.clear()
            out.append(found)
        return out


class Wanted:
    """The words that a model's features speak of, and which tokens may read as one of them."""

    def __init__(self, features: Iterable[str]):
        self.known = {f[:-2] if f.endswith(("#2", "#3")) else f for f in features}
        self.heads = {f[1:5] for f in self.known if f[0] == "^"}  # of all beginnings that count
        #: Words that short tokens may make together; shorter ones would be found everywhere.
        self.joined = np.asarray(sorted({word_hash(f) for f in self.known if f[0] != "^" and 4 <= len(f) <= _TOGETHER}), np.uint64)
        self.dull: set[bytes] = set()
        #: The first letters of all known words, repetitions left out, as numbers to the base of 27.
        self.starts = np.zeros(A**_STARTS, bool)
        for f in self.known:
            runs = [c for c, _ in groupby(f.lstrip("^"))][:_STARTS]
            code = 0
            for c in [*(ord(c) - 96 for c in runs), *[0] * _STARTS][:_STARTS]:
                code = code * A + c
            more = A ** (_STARTS - len(runs)) if f[0] == "^" else 1  # after a beginning, any letters may follow
            self.starts[code : code + more] = True

    def has(self, word: str) -> bool:
        return word in self.known or (word[:4] in self.heads and not self.known.isdisjoint(_keys(word)))

    def may_be(self, raw: np.ndarray, t: Tokens) -> np.ndarray:
        """Tokens to look into: all but those of plain letters (signs around them aside) that start like no known word.

        However its repetitions are read, the letters of a token stay in order, so its start without repetitions is that of all
        its readings.
        """
        n = len(raw)
        if not len(t.start):
            return np.zeros(0, bool)
        start, end = t.start.copy(), t.end.copy()
        for _ in range(3):
            end -= (end - start > 1) & _ENDS[raw[end - 1]]
        start += (end - start > 1) & _BEGINS[raw[start]]
        letter = _PLAIN[raw]
        lead = raw == 0xC3  # the first byte of an accented letter
        second = np.flatnonzero(np.append(False, lead[:-1]))
        letter[second] = _C3[raw[second]]
        odd = np.append(0, np.cumsum((letter == 0) & ~lead, dtype=np.int32))
        plain = odd[end] == odd[start]
        kept = np.flatnonzero(~lead)
        fresh = np.append(True, letter[kept[1:]] != letter[kept[:-1]]) if len(kept) else np.zeros(0, bool)
        begin = np.append(0, np.cumsum(~lead, dtype=np.int32))[start]  # of the first letter's byte among the kept
        fresh[np.minimum(begin, len(fresh) - 1)] = True
        at = kept[fresh]
        first = np.cumsum(fresh, dtype=np.int32)[np.minimum(begin, len(fresh) - 1)] - 1
        code = np.zeros(len(start), np.int64)
        for k in range(_STARTS):
            i = np.minimum(first + k, len(at) - 1)
            ok = (first + k < len(at)) & (at[i] < end)
            code = code * A + np.where(ok, letter[np.minimum(at[i], n - 1)], 0)
        return ~plain | self.starts[np.where(plain, code, 0)]


_STARTS = 5
_PLAIN = np.zeros(256, np.int8)
_PLAIN[97:123] = np.arange(1, 27)
_ENDS = np.array([chr(i) in _TRIM_R and i < 128 for i in range(256)])
_BEGINS = np.array([chr(i) in _TRIM_L and i < 128 for i in range(256)])
#: Longer spellings are not remembered.
_KEPT = 64
#: Bytes of tokens that may be parts of a word, and of their run together.
_SHORT, _TOGETHER, _TOKENS = 8, 16, 6


def _parts(raw: np.ndarray):
    """Ranges of about a piece of one long text, cut where no run of short tokens is."""
    a, n = 0, len(raw)
    while a < n:
        z = min(a + PIECE, n)
        if z < n:
            t = Tokens(raw[a:z], np.asarray([0, z - a]), ~SPACE, hashes=False)
            long = np.flatnonzero((t.end - t.start > _SHORT) & (t.end < z - a))
            if len(long):
                z = a + int(t.end[long[-1]])
            elif len(t.end) > 1:  # the longest but the last, which may go on
                size = (t.end - t.start)[:-1]
                z = a + int(t.end[np.flatnonzero(size == size.max())[-1]])
            else:  # one long token: to its end
                while z < n and not SPACE[raw[z]]:
                    gap = np.flatnonzero(SPACE[raw[z : z + PIECE]])
                    z = z + int(gap[0]) if len(gap) else min(z + PIECE, n)
        yield a, z
        a = z


#: Bytes as the letters that they stand for most often, to find runs that may make a word.
_READ = np.arange(256, dtype=np.uint8)
for _c, _to in LEET.items():
    if _c < "\x80":
        _READ[ord(_c)] = ord(_to[0])
_AFTER = np.array([chr(i) in "\"').,;:!?" for i in range(256)])
_POWERS = np.asarray([pow(0x9E3779B97F4A7C55 | 1, i, 1 << 64) for i in range(_TOGETHER + 1)], np.uint64)


def word_hash(word: str) -> int:
    return sum(b * int(p) for b, p in zip(word.encode(), _POWERS, strict=False)) & ((1 << 64) - 1)


def _token_hashes(raw: np.ndarray, t: Tokens, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(t.start), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(_SHORT):
            here = np.flatnonzero(size > i)
            out[here] += _READ[raw[t.start[here] + i]].astype(np.uint64) * _POWERS[i]
    return out


def _makes_a_word(raw: np.ndarray, t: Tokens, joined: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of two to six short tokens of one text that together read as a word of ``joined``."""
    size = t.end - t.start
    short = np.where(size <= _SHORT, size, 0)
    hashes = _token_hashes(raw, t, short)
    # the last token of a run may have signs after it
    bare = short.copy()
    for _ in range(2):
        bare -= (bare > 1) & _AFTER[raw[t.start + np.maximum(bare, 1) - 1]]
    known = np.zeros(1 << 16, bool)
    known[(joined >> np.uint64(48)).astype(np.int64)] = True
    # tokens i.. i+n-1, from the hash of i and that of the n-1 after it
    at, total, out = np.flatnonzero(short), _token_hashes(raw, t, bare), []
    for n in range(2, _TOKENS + 1):
        ok = (at + n - 1 < len(size)) if len(at) else np.zeros(0, bool)
        at = at[ok]
        last = at + n - 1
        at = at[(short[last] > 0) & (t.doc[last] == t.doc[at])]
        with np.errstate(over="ignore"):
            made = hashes[at] + _POWERS[np.minimum(short[at], _TOGETHER)] * total[at + 1]
        length = short[at].copy()
        for k in range(1, n):
            length += short[at + k]
        keep = length <= _TOGETHER
        at, made = at[keep], made[keep]
        total = np.zeros(len(hashes), np.uint64)
        total[at] = made
        hit = np.flatnonzero(known[(made >> np.uint64(48)).astype(np.int64)])
        hit = hit[np.isin(made[hit], joined)]
        out += [(int(i), int(i) + n) for i in at[hit]]
    return out


def _spaced_runs(raw: np.ndarray, t: Tokens, joined: np.ndarray | None = np.zeros(0, np.uint64)) -> dict[int, list[tuple[int, int]]]:
    """Byte ranges, by text, of tokens that may be parts of a word.

    Three or more one-character tokens in a row (a token may have separators besides), and short tokens that together read as
    a word of ``joined``; if that is None, all runs of short tokens.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(t.start):
        return out
    lead = (raw & 0xC0) != 0x80
    dot = np.append((raw[:-1] == 0xC2) & (raw[1:] == 0xB7), False)  # the separator of two bytes
    chars, others = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in (lead, lead & ~_SEPARATOR[raw] & ~dot))
    one = (chars[t.end] - chars[t.start] == 1) | (others[t.end] - others[t.start] == 1)
    runs = [(a, z) for a, z in _rows_of(one, t.doc) if z - a >= 3]
    if joined is None:
        runs += [(a, z) for a, z in _rows_of(t.end - t.start <= _SHORT // 2, t.doc) if z - a >= 2]
    elif len(joined):
        runs += _makes_a_word(raw, t, joined)
    for a, z in runs:
        out.setdefault(int(t.doc[a]), []).append((int(t.start[a]), int(t.end[z - 1])))
    return out


def _rows_of(ok: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of each row of tokens of one text that are ``ok``."""
    go = ok & np.append(False, ok[:-1] & (doc[1:] == doc[:-1]))
    at, stops = np.flatnonzero(ok & ~go), np.append(np.flatnonzero(~go), len(go))
    ends = stops[np.searchsorted(stops, at, "right")]
    return list(zip(at.tolist(), ends.tolist(), strict=True))


# ---------------------------------------------------------------- classifier


class Model(NamedTuple):
    lm: np.ndarray
    words: dict[str, float]
    bias: float


_PREFIXES = (4, 5, 6)


def _keys(word: str) -> tuple[str, ...]:
    """The word, and its beginnings (inflected languages build a family of words on one)."""
    return (word, *("^" + word[:k] for k in _PREFIXES if len(word) > k))


def features(words: set[str]) -> list[str]:
    """Features of a text: its words, their beginnings, and beginnings that two or three different words share."""
    counts: dict[str, int] = {}
    for w in words:
        for k in _keys(w):
            counts[k] = counts.get(k, 0) + 1
    out = list(counts)
    out += [k + "#2" for k, n in counts.items() if n > 1]
    out += [k + "#3" for k, n in counts.items() if n > 2]
    return sorted(out)


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for i in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + b
        g = y - 1 / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, g[row], width) - ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.3 * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w + step[:-1], b + float(step[-1])
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, vocabulary: int = 3000, evidence: float = 3.2, ridge: float = 0.05
) -> Model:
    """Language model from all texts; classifier from at most ``sample`` labelled ones outside the held-out third.

    Features enter the classifier if their log-odds of being in toxic documents stand ``evidence`` standard
    errors above none; at most ``vocabulary`` of them.
    """
    spark = prepare(docs.sparkSession)
    lm = language_model(count_characters(docs))
    shared = spark.sparkContext.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, none = Decoder(shared.value), np.zeros(0, np.uint64)  # no corpus words to join to yet
        for b in batches:
            words = [features(w) for w in decoder.restored(b.column("text"), joined=none)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "y", "words"]
            )

    rows = materialize(
        training_rows(docs, labels, "toxic", sample)
        .select("doc_id", "y", "text")
        .mapInArrow(run, "doc_id long, y int, words array<string>"),
        "toxic-words",
    )
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model(lm, {}, 30.0 * (1 if n and toxic == n else -1))
    clean = n - toxic
    x, y = F.col("x") + F.lit(0.5), F.col("n") - F.col("x") + F.lit(0.5)
    odds = F.log(x / (F.lit(toxic + 1.0) - x)) - F.log(y / (F.lit(clean + 1.0) - y))
    chosen = (
        rows.select("y", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("y").alias("x"), F.count("*").alias("n"))
        .where("x >= 3")
        .withColumn("z", odds / F.sqrt(1 / x + 1 / y))
        .where(F.col("z") > evidence)
        .orderBy(F.desc("z"), "word")
        .limit(vocabulary)
        .toPandas()["word"]
        .tolist()
    )
    number = {w: i for i, w in enumerate(sorted(chosen))}
    words = spark.createDataFrame(list(number.items()), "word string, number int")  # ``vocabulary`` rows at most
    pairs = rows.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(words), "word")
    found = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list("number")).alias("found"))  # as many at most
    data = rows.select("doc_id", "y").join(found, "doc_id", "left").toPandas().sort_values("doc_id")
    known = [np.zeros(0, np.int32) if r is None else np.asarray(r, np.int32) for r in data["found"]]
    w, b = _logistic(known, data["y"].to_numpy(float), len(number), ridge)
    return Model(lm, {x: float(w[i]) for x, i in number.items()}, b)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, weights, bias = shared.value
        decoder, wanted = Decoder(lm), Wanted(weights)
        for b in batches:
            z = [
                bias + sum(weights.get(f, 0.0) for f in features(words))
                for words in decoder.restored(b.column("text"), wanted.joined, wanted)
            ]
            z = np.asarray(z, np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"]
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, "doc_id long, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def restore(docs: DataFrame, lm: np.ndarray) -> DataFrame:
    """(doc_id, words): the sorted words of each restored text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(lm)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "words": [sorted(w) for w in decoder.restored(pa.array(b["text"], pa.string()))]})

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).mapInPandas(run, "doc_id long, words array<string>")
