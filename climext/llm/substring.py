"""Repeated passages, found exactly with an FM-index per shard.

A window is ``k`` consecutive words of a document.  Words covered by a window whose words also start earlier
(smaller doc_id, or same document and earlier start) go.

A window's *anchor* is the least hash among its m-word grams, so equal windows have equal anchors.  Only
windows whose anchor occurs twice anywhere can repeat; their runs (segments) are sent to the shard of the
anchor.  Each shard builds a compressed FM-index over its segments' words (suffix array by doubling,
Burrows-Wheeler transform, wavelet matrix with packed bits and sampled ranks).  The segments are streamed
through it from right to left: a backward step extends the match by one word, and the match is then cut to
``k`` words again (truncated matching statistics), which gives for every window the interval of its
occurrences and, by the least place in it, whether an earlier one exists.

Skew: exact copies are answered by their digest before anything is sent; equal segments meet within a task
and before the shard; windows of anchors that occur more than ``hot`` times are sent one by one under the hash
of all their words, so a passage that a third of all documents share spreads over all shards.

Definitions for unusual input: a null text has no words; a null doc_id sorts last; rows that share a doc_id are
ordered by the 64-bit hash of their text, and rows that agree in both share their results (neither is
earlier); documents of under ``k`` words keep all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Tokens, compressed, keyed, materialize, mix, plain, prepare, shingle_hashes, string_buffers, text_blocks, with_key

IS_WORD = ~SPACE


class Runs:
    """Anchors of the windows of a block of texts, as runs of windows with one anchor place.

    ``doc``, ``anchor``: of each run; ``lo``, ``hi``: its windows, by the number of their first word.
    """

    def __init__(self, t: Tokens, k: int, m: int):
        n = len(t.start)
        wide = k - m + 1
        grams = shingle_hashes(t.hash, m)
        count = n - k + 1
        if count <= 0:
            self.doc = self.lo = self.hi = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U64)
            return
        # sliding minimum, leftmost on ties, by doubling
        value, place, span = grams, np.arange(len(grams)), 1
        while span < wide:
            step = min(span, wide - span)
            a, b = value[: len(value) - step], value[step:]
            left = a <= b
            value, place = np.where(left, a, b), np.where(left, place[: len(place) - step], place[step:])
            span += step
        inside = t.doc[:count] == t.doc[k - 1 :]
        w = np.flatnonzero(inside)
        if not len(w):
            self.doc = self.lo = self.hi = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U64)
            return
        p = place[w]
        new = np.empty(len(w), bool)
        new[0] = True
        new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1) | (t.doc[w[1:]] != t.doc[w[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(w)) - 1
        self.lo, self.hi = w[first], w[last] + 1
        self.doc, self.anchor = t.doc[self.lo], value[self.lo]


def _blocks(texts: pa.Array):
    raw, offsets = string_buffers(texts)
    for lo, hi in text_blocks(offsets):
        yield lo, hi, Tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], IS_WORD)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- the index of a shard


class Bits:
    """Packed bit vector; ranks from counts sampled every 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        words = np.zeros(n // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int32)
        self.before = np.zeros(len(words) + 1, np.int32)
        np.cumsum(ones, out=self.before[1:])
        self.ones = int(self.before[-1])
        self.n = n

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        part = self.words[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.before[w] + np.bitwise_count(part)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.bits = max(1, int(sigma - 1).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            v = Bits(bit)
            self.levels.append((b, v, len(seq) - v.ones))
            seq = np.concatenate([seq[~bit], seq[bit]])
        first = np.full(sigma, -1, np.int64)
        values, at = np.unique(seq, return_index=True)
        first[values] = at
        self.first = first  # of each symbol in the last level

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``i`` (symbols must occur in the sequence)."""
        i = i.astype(np.int64)
        for b, v, zeros in self.levels:
            r = v.rank1(i).astype(np.int64)
            i = np.where(symbol >> b & 1, zeros + r, i - r)
        return i - self.first[symbol]


class FMIndex:
    """Backward search over segments of words for patterns of up to 32 words.

    Segments are joined with the separator 0; rows are sorted by 32 words, which decides all patterns used.
    """

    def __init__(self, seq: np.ndarray, sigma: int, k: int):
        n = len(seq)
        self.seq, self.k = seq, k
        rank = seq.astype(np.int64)
        span, ranks = 1, {1: rank}
        while span < 32:
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:] + 1
            rank = np.unique(rank * (n + sigma + 2) + ahead, return_inverse=True)[1]
            span *= 2
            ranks[span] = rank
        self.sa = np.argsort(rank, kind="stable")
        self.bwt = seq[self.sa - 1]
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        counts = np.bincount(seq, minlength=sigma)
        self.c = np.cumsum(counts) - counts
        # rows that agree in their first k words: 16 words, and 16 words from k-16 on
        r16 = ranks[16]
        shifted = np.zeros(n, np.int64)
        shifted[: n - (k - 16)] = r16[k - 16 :]
        a, b = r16[self.sa], shifted[self.sa]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.group_lo = starts[group]
        self.group_hi = np.append(starts[1:], n)[group]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with ``symbol`` and go on as the rows lo..hi."""
        c = self.c[symbol]
        return c + self.wavelet.rank(symbol, lo), c + self.wavelet.rank(symbol, hi)


def earlier_windows(segments: list[str], doc_rank: np.ndarray, start: np.ndarray, k: int) -> list[np.ndarray]:
    """For each window of each segment, whether an equal window starts earlier in the shard."""
    ids: dict[str, int] = {}
    flat, lens = [], np.zeros(len(segments), np.int64)
    for i, s in enumerate(segments):
        w = [ids.setdefault(x, len(ids) + 1) for x in s.split(" ") if x]
        lens[i] = len(w)
        flat += w
        flat.append(0)
    seq = np.asarray(flat, np.int64)
    ends = np.cumsum(lens + 1) - 1  # of each segment: the place of its separator
    begins = ends - lens
    fm = FMIndex(seq, len(ids) + 1, k)
    order = np.full(len(seq), np.iinfo(np.int64).max)
    own = np.repeat((doc_rank << 32) + start, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    order[seq > 0] = own
    # least place within each group of rows that agree in k words
    first = np.flatnonzero(np.r_[True, fm.group_lo[1:] != fm.group_lo[:-1]])
    least = np.minimum.reduceat(order[fm.sa], first)
    group_of = np.cumsum(np.r_[True, fm.group_lo[1:] != fm.group_lo[:-1]]) - 1
    out = [np.zeros(max(0, n - k + 1), bool) for n in lens]
    live = np.flatnonzero(lens >= k)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(seq), np.int64)
    matched = np.zeros(len(live), np.int64)
    at = ends[live] - 1
    while len(live):
        lo, hi = fm.step(seq[at], lo, hi)
        matched = matched + 1
        full = np.flatnonzero(matched >= k)
        if len(full):
            # the match is k+1 words at most here: cut it to k by widening to the rows that agree in k
            row = lo[full]
            lo[full], hi[full] = fm.group_lo[row], fm.group_hi[row]
            matched[full] = k
            hit = least[group_of[row]] < order[at[full]]
            for s, p, h in zip(live[full].tolist(), (at[full] - begins[live[full]]).tolist(), hit.tolist(), strict=True):
                out[s][p] = h
        at = at - 1
        go = at >= begins[live]
        live, lo, hi, at, matched = live[go], lo[go], hi[go], at[go], matched[go]
    return out


# ---------------------------------------------------------------- the distributed job


def removal_plan(docs: DataFrame, k: int = 20, m: int = 4, hot: int = 500, shard_words: int = 400_000) -> DataFrame:
    """(__id, __key, copy, normal, hot, found): all that a task needs to cut a document; only documents that may lose words."""
    assert 16 < k <= 31 and 1 <= m < k
    prepare(docs.sparkSession)
    base = keyed(docs)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for lo, hi, t in _blocks(texts):
                r = Runs(t, k, m)
                cuts = np.searchsorted(r.doc, np.arange(hi - lo + 1))
                anchors = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(_signed(r.anchor)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in ("__id", "__key", "sha")), anchors],
                    names=["__id", "__key", "sha", "anchors"],
                )

    seen = base.withColumn("sha", F.unhex(F.sha2("text", 256))).mapInArrow(
        survey, "__id long, __key long, sha binary, anchors array<long>"
    )
    seen = materialize(seen.withColumn("rid", F.monotonically_increasing_id()), "anchors")
    long_enough = seen.where(F.size("anchors") > 0)
    # exact copies: all but the least are covered from end to end
    least = long_enough.groupBy("sha").agg(F.min("__id").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = materialize(least, "least")  # so that the join's hot keys can be split
    copies = materialize(
        long_enough.select("rid", "__id", "__key", "sha").join(least, "sha").where("__id > least").select("rid", "__id", "__key"),
        "copies",
    )
    single = long_enough.join(copies.select("rid"), "rid", "left_anti")
    anchors = single.select("rid", F.explode("anchors").alias("anchor"))
    often = materialize(
        anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") > hot), "often"
    )
    words = often.agg(F.coalesce(F.sum(F.least(F.col("n"), F.lit(4 * hot))), F.lit(0))).first()[0] * (k + 8)
    shards = max(1, -(-words // shard_words))
    wanted = (
        anchors.join(often.select("anchor", "hot"), "anchor")
        .groupBy("rid")
        .agg(
            F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("normal"),
            F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"),
        )
    )
    wanted = materialize(seen.select("rid", "__id", "__key").join(wanted, "rid").drop("rid").dropDuplicates(["__id", "__key"]), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in _blocks(plain(b.column("text"))):
                ids, keys = b.column("__id").slice(lo, hi - lo).to_numpy(), b.column("__key").slice(lo, hi - lo).to_numpy()
                text = np.where(IS_WORD[t.raw], t.raw, 32).astype(np.uint8).tobytes()
                rows = {"shard": [], "__id": [], "__key": [], "start": [], "segment": []}
                for d, units in _units(t, b, lo, hi, k, m):
                    seen_here = set()
                    for anchor, a, z in units:
                        s = text[t.start[a] : t.end[z + k - 2]]
                        if (anchor, s) in seen_here:
                            continue
                        seen_here.add((anchor, s))
                        rows["shard"].append(anchor)
                        rows["__id"].append(ids[d])
                        rows["__key"].append(keys[d])
                        rows["start"].append(a - t.first[d])
                        rows["segment"].append(s)
                if rows["shard"]:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows["shard"], pa.int64()),
                            pa.array(rows["__id"], pa.int64()),
                            pa.array(rows["__key"], pa.int64()),
                            pa.array(rows["start"], pa.int64()),
                            pa.array(rows["segment"], pa.binary()).cast(pa.string()),
                        ],
                        names=list(rows),
                    )

    segments = (
        compressed(base)
        .join(wanted, ["__id", "__key"])
        .dropDuplicates(["__id", "__key"])
        .mapInArrow(cut, "shard long, __id long, __key long, start long, segment string")
        .groupBy("shard", "segment")
        .agg(F.min(F.struct("__id", "__key", "start")).alias("at"))
        .select(F.pmod(F.xxhash64("shard"), F.lit(shards)).alias("shard"), "segment", "at.*")
    )

    def search(part):
        keys = pd.MultiIndex.from_arrays([part["__id"], part["__key"]])
        code, uniques = keys.factorize()
        where = np.lexsort((uniques.get_level_values(1), uniques.get_level_values(0)))
        rank = np.empty(len(where), np.int64)
        rank[where] = np.arange(len(where))
        found = earlier_windows(part["segment"].tolist(), rank[code], part["start"].to_numpy(), k)
        return pd.DataFrame(
            {
                "__id": part["__id"],
                "__key": part["__key"],
                "start": part["start"],
                "bits": [x.astype(np.uint8).tobytes() for x in found],
            }
        )

    results = (
        segments.groupBy("shard")
        .applyInPandas(search, "__id long, __key long, start long, bits binary")
        .groupBy("__id", "__key")
        .agg(F.collect_list(F.struct("start", "bits")).alias("found"))
    )
    empty = F.array().cast("array<long>")
    plan = wanted.join(results, ["__id", "__key"], "left").select("__id", "__key", F.lit(False).alias("copy"), "normal", "hot", "found")
    gone = copies.select("__id", "__key").distinct().select(
        "__id",
        "__key",
        F.lit(True).alias("copy"),
        empty.alias("normal"),
        empty.alias("hot"),
        F.array().cast("array<struct<start:long,bits:binary>>").alias("found"),
    )
    return plan.unionByName(gone)


def _units(t: Tokens, b: pa.RecordBatch, lo: int, hi: int, k: int, m: int, prefix: str = ""):
    """(document, its (shard key, first window, one past the last window)) of a block.

    A run of windows with an anchor in ``normal`` is one unit; with one in ``hot``, each window is.
    """
    r = Runs(t, k, m)
    cuts = np.searchsorted(r.doc, np.arange(hi - lo + 1))
    whole = None
    for d in range(hi - lo):
        a, z = cuts[d], cuts[d + 1]
        normal, hot = b.column(prefix + "normal")[lo + d].values, b.column(prefix + "hot")[lo + d].values
        if a == z or normal is None or not (len(normal) + len(hot)):
            continue
        anchor = _signed(r.anchor[a:z])
        units = []
        for i in (a + np.flatnonzero(np.isin(anchor, normal.to_numpy()))).tolist():
            units.append((int(anchor[i - a]), int(r.lo[i]), int(r.hi[i])))
        if len(hot):
            if whole is None:
                whole = _signed(mix(shingle_hashes(t.hash, k)))
            for i in (a + np.flatnonzero(np.isin(anchor, hot.to_numpy()))).tolist():
                units += [(int(whole[w]), w, w + 1) for w in range(int(r.lo[i]), int(r.hi[i]))]
        yield d, units


def cut_repeats(docs: DataFrame, k: int = 20, m: int = 4, **how) -> DataFrame:
    """The rows of ``docs`` with ``kept_text`` (kept words joined by a space), ``n_words`` and ``n_removed``."""
    # names that no input column has
    plan = removal_plan(docs, k, m, **how).withColumnsRenamed({c: f"__plan_{c}" for c in ("copy", "normal", "hot", "found")})
    rest = [c for c in docs.columns if c not in ("text", "kept_text", "n_words", "n_removed")]
    keyed_rows = with_key(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = compressed(keyed_rows.select(*rest, "text", "__id", "__key")).join(plan, ["__id", "__key"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column("text"))
            for lo, hi, t in _blocks(texts):
                n = len(t.start)
                gone = np.zeros(n + 1, np.int64)
                for d in np.flatnonzero(b.column("__plan_copy").slice(lo, hi - lo).fill_null(False).to_numpy(False)).tolist():
                    gone[t.first[d]] += 1
                    gone[t.first[d + 1]] -= 1
                for d, units in _units(t, b, lo, hi, k, m, "__plan_"):
                    found = {x["start"]: x["bits"] for x in b.column("__plan_found")[lo + d].as_py() or ()}
                    for _, a, z in units:
                        bits = found.get(a - int(t.first[d]))
                        if bits is None:  # the same segment is earlier elsewhere
                            gone[a] += 1
                            gone[z + k - 1] -= 1
                        else:
                            for w in np.flatnonzero(np.frombuffer(bits, np.uint8)).tolist():
                                gone[a + w] += 1
                                gone[a + w + k] -= 1
                keep = np.cumsum(gone[:-1]) == 0 if n else np.zeros(0, bool)
                kept, removed = _kept(t, keep, hi - lo)
                words = np.diff(t.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(lo, hi - lo) for c in rest),
                        texts.slice(lo, hi - lo),
                        kept,
                        pa.array(words, pa.int64()),
                        pa.array(removed, pa.int64()),
                    ],
                    names=[*rest, "text", "kept_text", "n_words", "n_removed"],
                )

    schema = docs.select(*rest, F.col("text").cast("string").alias("text")).schema
    schema = schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(apply, schema)


def _kept(t: Tokens, keep: np.ndarray, docs: int) -> tuple[pa.Array, np.ndarray]:
    """Kept words of each document joined by single spaces, and how many went."""
    total = np.concatenate([[0], np.cumsum(keep)])
    removed = np.diff(t.first) - np.diff(total[t.first])
    size = (t.end - t.start + 1) * keep
    # copy words by runs of equal shift: bytes of kept words, each followed by a space
    s, e = t.start[keep], t.end[keep]
    length = e - s + 1
    ends = np.cumsum(length)
    if len(s):
        src = np.repeat(s - (ends - length), length) + np.arange(int(ends[-1]))
        data = t.raw[np.minimum(src, len(t.raw) - 1)].copy()
        data[ends - 1] = 32
    else:
        data = np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])[t.first]
    text = data.tobytes()
    out = [text[a : max(a, z - 1)] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    assert len(out) == docs
    return pa.array(out, pa.binary()).cast(pa.string()), removed
