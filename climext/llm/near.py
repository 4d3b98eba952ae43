"""Near duplicates by DartMinHash signatures, banding and exact verification.

A document is the multiset of its shingles of five words (lower-cased runs of letters, digits and
underscores); fewer than five words make one shingle.  Two documents are linked where the weighted Jaccard
similarity of their multisets (sum of minima over sum of maxima) is ``threshold`` or more; classes are the
connected components of the links, named by their least doc_id.

Signature (DartMinHash): an element of weight w owns a region w wide and endless along the rank axis; here the
weight is the number of times a shingle occurs, and any real weight does.  Darts fall on it as a Poisson process whose
randomness comes from hashes of the element and the place, so where regions overlap they hold equal darts in all
documents.  Ranks are cut into dyadic cells, weights into dyadic columns; a document looks only at cells below its
own rank bound (darts wanted / total weight), so the work hardly depends on its weights.  Each dart is dealt to one of K
coordinates; the earliest of each is the signature, and two documents agree in a coordinate with probability
equal to their weighted Jaccard similarity.

Candidates share all ``rows`` coordinates of one of the bands.  They are joined by stars (every member with its
bucket's least), so a bucket of n documents sends n links, never n^2.  Connected families of up to
``family`` documents are verified whole in one task each.  In larger ones members are verified against pivots, rounds of
which merge what hangs together; only members of classes that stay apart, and that the triangle inequality leaves open,
are compared block with block.  A large family of classes that are near but never linked still costs about the square of
their members.

Definitions for unusual input: null counts as empty; texts without a word form one class; a null doc_id sorts
last; copies (equal word sequences) meet before anything else, so a copied text counts once; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, U64, WORD, Words, keyed, materialize, mix, prepare, shingle_hashes, string_buffers, text_blocks, unit, with_key, wrapped

K, ROWS, SHINGLE = 120, 5, 5


# ---------------------------------------------------------------- shingles and darts


def shingle_counts(t: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, times) of a block, sorted by document and shingle."""
    docs, words = len(t.first) - 1, np.diff(t.first)
    h = shingle_hashes(t.hash, k)
    if docs == 1:
        value = h
        doc = np.zeros(len(h), np.int32)
    else:
        of = np.repeat(np.arange(docs, dtype=np.int32), words)
        ok = np.flatnonzero(of[: len(h)] == of[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        doc, value = of[ok], h[ok]
    few = np.flatnonzero((words > 0) & (words < k))
    if len(few):
        with np.errstate(over="ignore"):
            weight = mix((np.arange(len(t.hash)) - np.repeat(t.first[:-1], words)).astype(U64))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(t.hash * weight, dtype=U64)])
            short = mix(sums[t.first[few + 1]] - sums[t.first[few]])
        doc, value = np.concatenate([doc, few.astype(np.int32)]), np.concatenate([value, short])
    if docs == 1:
        value = np.sort(value)
    else:
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])[: len(doc)])) if len(doc) else np.zeros(0, np.int64)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def shingle_units(t: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit unit): the j-th copy of a shingle in a document is unit (shingle, j), so that units are sets."""
    doc, value, times = shingle_counts(t, k)
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, value = np.repeat(doc, times), np.repeat(value, times)
    with np.errstate(over="ignore"):
        value = np.where(copy > 0, mix(value + copy.astype(U64) * U64(0xA0761D6478BD642F)), value)
    order = np.argsort(value, kind="stable") if len(t.first) == 2 else np.lexsort((value, doc))
    return doc[order], value[order]


_LOW, _HIGH = -7, 9  # the first cell is [0, 2**_LOW); cells from 2**_HIGH on are 2**_HIGH wide


def _cell(c: int) -> tuple[float, float]:
    """Rank range of a cell: dyadic below 2**_HIGH, of equal width above."""
    if c == 0:
        return 0.0, 2.0**_LOW
    if c <= _HIGH - _LOW:
        return 2.0 ** (_LOW + c - 1), 2.0 ** (_LOW + c)
    return (c - _HIGH + _LOW) * 2.0**_HIGH, (c - _HIGH + _LOW + 1) * 2.0**_HIGH


def _cells_below(rank: np.ndarray) -> np.ndarray:
    """Number of the first cells that cover ranks below ``rank``."""
    low = np.ceil(np.log2(np.maximum(rank, 2.0**_LOW))) - _LOW + 1
    return np.where(rank <= 2.0**_HIGH, low, np.ceil(rank / 2.0**_HIGH) + _HIGH - _LOW).astype(np.int64)


@lru_cache(maxsize=512)
def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count."""
    j = np.arange(int(mean + 12 * mean**0.5 + 20))
    log_p = j * np.log(mean) - mean - np.cumsum(np.log(np.maximum(j, 1)))
    return np.cumsum(np.exp(log_p))


def dart_signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int, k: int = K, chunk: int = 1 << 20) -> np.ndarray:
    """Signatures (docs x k, uint64) of documents given by elements and their weights (any above 0), grouped by document.

    An element's region is ``weight`` wide.  It is laid out in columns [0, 1), [1, 2), [2, 4), [4, 8) and so on, the same
    in every document; of a column that the region only partly fills, the darts within it count.  Rows of
    documents without elements are 0.
    """
    best = np.full(docs * k, np.inf)
    out = np.zeros(docs * k, U64)
    total = np.bincount(doc, weight, minlength=docs)
    darts = k * (np.log(k) + 3)
    done = np.zeros(docs, np.int64)  # cells already looked at
    bound = np.where(total > 0, darts / np.maximum(total, 1e-9), 0)
    widest = int(np.ceil(np.log2(max(weight.max(initial=0), 1)))) + 1
    while True:
        want = np.where(bound > 0, _cells_below(bound), 0)
        for c in range(int(done[want > done].min(initial=1 << 30)), int(want.max(initial=0))):
            mine = (want > c) & (done <= c)
            lo, hi = _cell(c)
            for at in range(0, len(doc), chunk):
                some = slice(at, at + chunk)
                for column in range(widest):
                    left, width = (0.0, 1.0) if not column else (2.0 ** (column - 1), 2.0 ** (column - 1))
                    here = at + np.flatnonzero(mine[doc[some]] & (weight[some] > left))
                    if len(here):
                        _throw(doc, value, weight, here, c, lo, hi, column, left, width, k, best, out)
        done = np.maximum(done, want)
        # darts beyond the bound were thrown by whole cells; a coordinate is settled if its dart lies within full cells
        empty = np.isinf(best.reshape(docs, k)).any(axis=1) & (total > 0)
        if not empty.any():
            return out.reshape(docs, k)
        bound = np.where(empty, bound * 2, 0)


def _throw(doc, value, weight, at, c, lo, hi, column, left, width, k, best, out) -> None:
    """Darts of the elements ``at`` on a cell of ranks and a column of weights; the earliest of each coordinate stay."""
    with np.errstate(over="ignore"):
        seed = mix(value[at] ^ (U64(c + 1) * U64(0x8EBC6AF09C88C6E3)) ^ (U64(column) * U64(0xD1B54A32D192ED03)))
    n = np.searchsorted(_poisson_table((hi - lo) * width), unit(seed))
    hit = np.flatnonzero(n)
    reps = n[hit]
    seed, at = np.repeat(seed[hit], reps), np.repeat(at[hit], reps)
    j = np.arange(len(seed)) - np.repeat(np.cumsum(reps) - reps, reps)
    with np.errstate(over="ignore"):
        dart = mix(seed + (j + 1).astype(U64) * U64(0xE7037ED1A0B428DB))
        inside = left + width * unit(mix(dart ^ U64(0x2545F4914F6CDD1D))) < weight[at]
        dart, at = dart[inside], at[inside]
        rank = lo + (hi - lo) * unit(mix(dart ^ U64(0x589965CC75374CC3)))
    slot = doc[at].astype(np.int64) * k + (mix(dart ^ U64(0x1D8E4E27C47D124F)) % U64(k)).astype(np.int64)
    order = np.lexsort((rank, slot))
    slot, rank, dart = slot[order], rank[order], dart[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    slot, rank, dart = slot[first], rank[first], dart[first]
    better = rank < best[slot]
    best[slot[better]], out[slot[better]] = rank[better], dart[better]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    docs, k = sig.shape
    with np.errstate(over="ignore"):
        out = np.zeros((docs, k // rows), U64)
        for r in range(rows):
            out = mix(out * U64(0x9FB21C651E98DF25) + sig[:, r::rows][:, : k // rows])
        return mix(out + np.arange(k // rows, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _blocks(texts: pa.Array):
    raw, offsets = string_buffers(_lowered(texts))
    for lo, hi in text_blocks(offsets, PIECE):
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD)


# ---------------------------------------------------------------- components


def _followed(df: DataFrame, column: str, up: DataFrame, name: str) -> DataFrame:
    """``df`` with ``column`` replaced by the root that ``up`` has for it.

    A job of its own from one written table to the next: a root that very many rows name is then a skewed join
    that Spark splits.
    """
    to = up.select(F.col("id").alias(column), F.col("root").alias("__to"))
    out = df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
    return materialize(out.select(*df.columns), name)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root) of every end of ``edges`` (a, b): the least id of its connected component.

    Rounds of hash-min with pointer jumping, each written to the shared folder; edges within a settled
    component fall away, so the work shrinks from round to round.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialize(both, name)
    label = None
    while not live.isEmpty():
        near = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the first label: the least neighbour
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
        # jump: follow the pointers of this round twice
        up = least = materialize(least, name)
        for _ in range(2):
            least = _followed(least, "root", up, name)
        label = least if label is None else _followed(label, "root", least, name)
        live = _followed(_followed(live, "a", least, name), "b", least, name)
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = materialize(live, name)
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    return label


# ---------------------------------------------------------------- verification


def _linked(units: list[np.ndarray], others: list[np.ndarray] | None, threshold: float, block: int = 256):
    """Pairs (i, j) with similarity >= threshold; all pairs i < j if ``others`` is None.

    Counts common units block by block by a product of 0/1 matrices over the units that two of them share.
    """
    right = units if others is None else others
    sizes_l = np.asarray([len(u) for u in units])
    sizes_r = np.asarray([len(u) for u in right])
    for i0 in range(0, len(units), block):
        left = units[i0 : i0 + block]
        for j0 in range(i0 if others is None else 0, len(right), block):
            mine = right[j0 : j0 + block]
            flat = np.concatenate([*left, *mine])
            values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1
            keep = times[inverse] > 1
            owner = np.repeat(np.arange(len(left) + len(mine)), [len(u) for u in (*left, *mine)])
            row, col = owner[keep], column[inverse[keep]]
            common = np.zeros((len(left), len(mine)), np.float32)
            width = int((times > 1).sum())
            for c0 in range(0, width, 4096):
                part = (col >= c0) & (col < c0 + 4096)
                m = np.zeros((len(left) + len(mine), min(4096, width - c0)), np.float32)
                m[row[part], col[part] - c0] = 1
                common += m[: len(left)] @ m[len(left) :].T
            total = sizes_l[i0 : i0 + block, None] + sizes_r[None, j0 : j0 + block] - common
            i, j = np.nonzero(common >= threshold * total - 1e-6)
            i, j = i + i0, j + j0
            if others is None:
                i, j = i[i < j], j[i < j]
            yield from zip(i.tolist(), j.tolist(), strict=True)


def _roots(n: int, pairs) -> np.ndarray:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.asarray([find(i) for i in range(n)])


def near_classes(
    docs: DataFrame, threshold: float = 0.8, family: int = 256, page: int = 128, family_units: int = 1 << 21
) -> DataFrame:
    """rid, __id, __none, __key, root, class_id, first: the class of every row.

    ``root`` is the class's number, ``first`` the ``rid`` of its first row, ``class_id`` that row's id (null if none has one).

    Families of up to ``family`` documents and ``family_units`` shingles are verified whole by one task each.
    """
    prepare(docs.sparkSession)
    base = keyed(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in _blocks(b.column("text")):
                n = hi - lo
                with np.errstate(over="ignore"):
                    place = mix((np.arange(len(t.hash)) - np.repeat(t.first[:-1], np.diff(t.first))).astype(U64) + U64(77))
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(t.hash ^ place), dtype=U64)])
                    more = np.concatenate([np.zeros(1, U64), np.cumsum(mix(t.hash + place), dtype=U64)])
                    w1, w2 = sums[t.first[1:]] - sums[t.first[:-1]], more[t.first[1:]] - more[t.first[:-1]]
                doc, value, times = shingle_counts(t)
                keys = band_keys(dart_signatures(doc, value, times.astype(np.float64), n))
                some = np.bincount(doc, minlength=n)
                keys = [k.view(np.int64) if w else k.view(np.int64)[:0] for k, w in zip(keys, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("__id").slice(lo, n),
                        b.column("__none").slice(lo, n),
                        b.column("__key").slice(lo, n),
                        pa.array(w1.view(np.int64)),
                        pa.array(w2.view(np.int64)),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["__id", "__none", "__key", "w1", "w2", "bands"],
                )

    signed = materialize(
        base.mapInArrow(sign, "__id long, __none boolean, __key long, w1 long, w2 long, bands array<long>").withColumn(
            "rid", F.monotonically_increasing_id()
        ),
        "signed",
    )
    # copies: rows of one word sequence are stood for by the first of them
    reps = materialize(
        signed.groupBy("w1", "w2").agg(F.min(F.struct("__id", "__none", "__key", "rid")).alias("rep")).select("w1", "w2", "rep.*"), "reps"
    )
    bands = signed.join(reps.select("rid"), "rid", "left_semi").select("rid", F.explode("bands").alias("band"))
    stars = bands.groupBy("band").agg(F.min("rid").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    edges = bands.join(stars, "band").select("a", F.col("rid").alias("b"))
    families = components(edges, "families")
    families = materialize(families.select(F.col("id").alias("rid"), F.col("root").alias("family")), "families")
    members = reps.join(families, "rid").select("rid", "__id", "__none", "__key", "family")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in _blocks(b.column("text")):
                doc, value = shingle_units(t)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                value = value.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid").slice(lo, hi - lo),
                        b.column("family").slice(lo, hi - lo),
                        pa.array([value[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["rid", "family", "units"],
                )

    units = materialize(
        base.join(members, ["__id", "__none", "__key"])
        .dropDuplicates(["rid"])
        .select("rid", "family", "text")
        .mapInArrow(shingle, "rid long, family long, units binary"),
        "units",
        "none",
    )
    size = units.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("units") / 8).alias("u"))
    large = materialize(size.where((F.col("n") > family) | (F.col("u") > family_units)).select("family"), "large")

    def within(part):
        part = part.sort_values("rid")
        rid = part["rid"].to_numpy()
        roots = _roots(len(rid), _linked([np.frombuffer(u, np.int64) for u in part["units"]], None, threshold))
        return pd.DataFrame({"a": rid[roots], "b": rid})

    small_links = units.join(large, "family", "left_anti").groupBy("family").applyInPandas(within, "a long, b long")
    links = materialize(small_links.where("a <> b"), "links")
    if not large.isEmpty():
        inside = materialize(units.join(large, "family"), "large", "none")
        links = links.unionByName(_large_links(inside, threshold, page, family_units))
    roots = components(materialize(links, "links"), "classes")
    # names: the least id among all rows of the class
    named = reps.join(roots.select(F.col("id").alias("rid"), "root"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid")
    )
    # written, so that the joins' hot classes can be split
    named = materialize(named, "named")
    least = F.min(F.struct("__id", "__none", "__key", "rid")).alias("least")
    names = materialize(named.groupBy("root").agg(least), "names")
    named = named.join(names, "root").select(
        "w1", "w2", "root", F.when(~F.col("least.__none"), F.col("least.__id")).alias("class_id"), F.col("least.rid").alias("first")
    )
    return signed.select("rid", "__id", "__none", "__key", "w1", "w2").join(named, ["w1", "w2"]).drop("w1", "w2")


def _distances(members: DataFrame, pivots: DataFrame, page: int, page_units: int) -> DataFrame:
    """(rid, cls, pivot, pivot_cls, far): distances of members (rid, family, cls, units) to their family's pivots.

    A family's members are dealt over tasks of up to ``page`` of them; each gets a copy of the family's pivots.
    """
    n, u = F.count("*"), F.sum(F.octet_length("units")) / (8 * page_units)
    deals = members.groupBy("family").agg(F.ceil(F.greatest(n / page, F.least(n, u))).cast("int").alias("deals"))
    deals = materialize(deals, "deals")
    dealt = members.join(deals, "family").withColumn("deal", F.pmod(F.xxhash64("rid"), F.col("deals")).cast("int"))
    copies = pivots.join(deals, "family").select(
        F.col("family").alias("of"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("to"), "pivot", "pivot_cls", "pivot_units"
    )

    def run(part, pivots):
        units = [np.frombuffer(u, np.int64) for u in part["units"]]
        out = []
        for pivot, cls, p in zip(pivots["pivot"], pivots["pivot_cls"], pivots["pivot_units"], strict=True):
            y = np.frombuffer(p, np.int64)
            common = np.asarray([np.isin(x, y, assume_unique=True).sum() for x in units], np.float64)
            total = np.asarray([len(x) for x in units], np.float64) + len(y) - common
            out.append(pd.DataFrame({"rid": part["rid"], "cls": part["cls"], "pivot": pivot, "pivot_cls": cls, "far": 1 - common / np.maximum(total, 1)}))
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "cls": [], "pivot": [], "pivot_cls": [], "far": []})

    return (
        dealt.select("family", "deal", "rid", "cls", "units")
        .groupBy("family", "deal")
        .cogroup(copies.groupBy("of", "to"))
        .applyInPandas(run, "rid long, cls long, pivot long, pivot_cls long, far double")
    )


def _large_links(units: DataFrame, threshold: float, page: int, page_units: int, rounds: int = 4, pivots: int = 8) -> DataFrame:
    """Links of families too large for one task.

    1. Every member is compared with the family's first pivot; those linked to it are one class.
    2. For some rounds, members are compared with a member of ``pivots`` large classes of the family, and classes
       that a link joins become one.  A round costs a few comparisons a member, and a family that hangs together
       soon is one class, which needs no more.
    3. Members of different classes that are left are compared page with page: x and y can be linked only if their distances to
       the first pivot differ by 1 - threshold at most, so pages are of rings around it, and only neighbouring rings meet.
       Within a family's largest class nothing is compared.
    """
    reach = 1 - threshold + 1e-9
    members = units.withColumn("cls", F.col("rid"))
    first = units.groupBy("family").agg(F.min(F.struct("rid", "units")).alias("p")).select(
        "family", F.col("p.rid").alias("pivot"), F.col("p.rid").alias("pivot_cls"), F.col("p.units").alias("pivot_units")
    )
    measured = materialize(_distances(members, materialize(first, "pivots", "none"), page, page_units), "measured")
    links = materialize(measured.where(F.col("far") <= reach).select(F.col("pivot").alias("a"), F.col("rid").alias("b")), "pivot-links")
    if measured.where(F.col("far") > reach).isEmpty():
        return links
    cls = units.select("rid", "family").join(
        measured.select("rid", "far", F.when(F.col("far") <= reach, F.col("pivot")).otherwise(F.col("rid")).alias("cls")), "rid"
    )
    cls = materialize(cls, "open")
    for turn in range(rounds):
        size = materialize(cls.groupBy("family", "cls").agg(F.count("*").alias("n"), F.min("rid").alias("pivot")), "sizes")
        open_ = size.groupBy("family").agg(F.count("*").alias("k")).where("k > 1").select("family")
        if open_.isEmpty():
            break
        # the largest class of each of so many parts, which differ from round to round
        part = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(pivots)).alias("part")
        largest = size.join(open_, "family").groupBy("family", part).agg(F.max(F.struct("n", "cls", "pivot")).alias("c"))
        chosen = largest.select("family", "c.cls", "c.pivot").join(units.select(F.col("rid").alias("pivot"), F.col("units").alias("pivot_units")), "pivot")
        chosen = materialize(chosen.select("family", "pivot", F.col("cls").alias("pivot_cls"), "pivot_units"), "pivots", "none")
        some = units.join(cls.select("rid", "cls"), "rid").join(open_, "family", "left_semi")
        near = _distances(some, chosen, page, page_units).where((F.col("far") <= reach) & (F.col("cls") != F.col("pivot_cls")))
        near = materialize(near.select(F.col("pivot_cls").alias("a"), F.col("cls").alias("b")).distinct(), "pivot-links")
        if near.isEmpty():
            break
        links = links.unionByName(near)
        cls = _followed(cls, "cls", components(near, "merged"), "open")
    return links.unionByName(_between_classes(units, cls, threshold, page, page_units))


def _between_classes(units: DataFrame, cls: DataFrame, threshold: float, page: int, page_units: int) -> DataFrame:
    """Links between members of different classes, by blocks of two pages of rings around the family's first pivot."""
    size = cls.groupBy("family", "cls").agg(F.count("*").alias("n"))
    main = size.groupBy("family").agg(F.max(F.struct("n", "cls")).alias("m"), F.count("*").alias("k")).where("k > 1")
    main = materialize(main.select("family", F.col("m.cls").alias("main")), "main")
    # rings as wide as the reach (and a bit, for rounding), ring 0 those linked to the pivot: x in ring r meets rings r-1, r, r+1; each ring is dealt over pages
    wide = 1 - threshold + 1e-6
    ring = F.when(F.col("far") <= 1 - threshold + 1e-9, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("far") / wide)))
    sized = units.join(cls.select("rid", "cls", "far"), "rid").join(main, "family").select(
        "family", "rid", "units", ring.cast("int").alias("ring"),
        F.when(F.col("cls") == F.col("main"), 0).otherwise(1).alias("part"),
    )
    sized = materialize(sized, "rings", "none")
    n, u = F.count("*"), F.sum(F.octet_length("units")) / (8 * page_units)
    pages = sized.groupBy("family", "ring", "part").agg(F.ceil(F.greatest(n / page, F.least(n, u))).cast("int").alias("pages"))
    pages = materialize(pages, "pages")
    sized = sized.join(pages, ["family", "ring", "part"]).withColumn(
        "page", F.pmod(F.xxhash64("rid"), F.col("pages")).cast("int")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("pages") - 1))
    left = pages.select("family", F.col("ring").alias("r1"), F.col("part").alias("t1"), each.alias("p1"))
    right = pages.select("family", F.col("ring").alias("r2"), F.col("part").alias("t2"), each.alias("p2"))
    # the largest class with itself and ring 0 with itself (all linked to the pivot) have no open pairs
    blocks = (
        left.join(right, "family")
        .where("t1 + t2 > 0 and r2 >= 1 and (r1 = r2 - 1 or (r1 = r2 and (t1 < t2 or (t1 = t2 and p1 <= p2))))")
        .withColumn("block", F.xxhash64("family", "r1", "t1", "p1", "r2", "t2", "p2"))
    )
    blocks = materialize(blocks, "blocks")
    on = ["family", "ring", "part", "page"]
    a = sized.join(blocks.withColumnsRenamed({"r1": "ring", "t1": "part", "p1": "page"}), on).select("block", "rid", "units", F.lit(0).alias("side"))
    b = sized.join(
        blocks.where("r1 <> r2 or t1 <> t2 or p1 <> p2").withColumnsRenamed({"r2": "ring", "t2": "part", "p2": "page"}), on
    ).select("block", "rid", "units", F.lit(1).alias("side"))

    def compare(part):
        part = part.sort_values(["side", "rid"])
        rid, n = part["rid"].to_numpy(), int((part["side"] == 0).sum())
        u = [np.frombuffer(x, np.int64) for x in part["units"]]
        if n == len(u):
            pairs = _linked(u, None, threshold)
        else:
            pairs = ((i, j + n) for i, j in _linked(u[:n], u[n:], threshold))
        roots = _roots(len(u), pairs)
        return pd.DataFrame({"a": rid[roots], "b": rid})

    return a.unionByName(b).groupBy("block").applyInPandas(compare, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of ``docs``: its id, class, class size, and whether it stays (one row of a class does)."""
    classes = materialize(near_classes(docs, **how), "near")
    size = materialize(classes.groupBy("root").agg(F.count("*").alias("class_size")), "sizes")
    return classes.join(size, "root").select(
        F.when(~F.col("__none"), F.col("__id")).alias("doc_id"),
        "class_id",
        "class_size",
        (F.col("rid") == F.col("first")).alias("kept"),
    )


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id."""
    inner, back = wrapped(docs)
    classes = near_classes(inner, **how)
    row = ["__id", "__none", "__key"]
    stay = materialize(classes.where("rid = first").select(*row), "stay")
    out = with_key(inner).join(stay, row, "left_semi")
    if not classes.groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(row)
    return back(out)
