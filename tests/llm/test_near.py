"""Weighted regions, signatures and classes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext.llm import near
from climext.llm.common import WORD, Words


@pytest.mark.parametrize("scale", [0.05, 1.0, 30.0, 4000.0])
def test_signatures_estimate_weighted_similarity(scale):
    """Real weights, below and above one, and one element that outweighs all others."""
    rng = np.random.default_rng(2)
    elements = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    n = len(elements)
    a, b = (np.round(rng.gamma(1.0, size=n), 3) + 0.001 for _ in range(2))
    a[0] = b[0] = 40.0
    a, b = a * scale, b * scale
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = near.dart_signatures(np.repeat([0, 1], n), np.tile(elements, 2), np.concatenate([a, b]), 2, 1500)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.05)
    # the weight of an element is the probability that a coordinate is its own
    only = near.dart_signatures(np.zeros(n, int), elements, a, 1, 1500)
    alone = near.dart_signatures(np.zeros(1, int), elements[:1], a[:1], 1, 1500)
    assert (only[0] == alone[0]).mean() == pytest.approx(a[0] / a.sum(), abs=0.05)


def test_chunks_change_nothing():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 9, 500))
    value, weight = rng.integers(0, 1 << 62, 500).astype(np.uint64), rng.gamma(2.0, size=500)
    assert (near.dart_signatures(doc, value, weight, 9) == near.dart_signatures(doc, value, weight, 9, chunk=7)).all()


def test_counts_and_pieces():
    text = (b"a b c d e " * 40 + b"x" * 90 + b" y-z.a b c d e").ljust(700)
    raw = np.frombuffer(text, np.uint8)
    whole, cut = Words(raw, np.asarray([0, len(raw)]), WORD), Words(raw, np.asarray([0, len(raw)]), WORD, 64)
    plain = len(text.replace(b"-", b" ").replace(b".", b" ").split())
    assert len(whole.hash) == len(cut.hash) == plain
    same = whole.hash == cut.hash
    assert same.sum() == plain - 1  # a word longer than a piece has another hash, in all documents
    doc, value, times = near.shingle_counts(whole)
    assert times.sum() == plain - 4 and times.max() >= 39 and (np.diff(value.astype(object)) > 0).all()
    _, units = near.shingle_units(whole)
    assert len(np.unique(units)) == len(units) == plain - 4


def test_a_family_bound_by_shingles_is_paged(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 200 + i] + [f"x{i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit(1))
    whole = {tuple(r) for r in near.near_duplicates(df).collect()}
    assert whole == {tuple(r) for r in near.near_duplicates(df, family_units=500).collect()}
    assert {r[1] for r in whole} == {0}


def test_least_and_missing_ids(spark):
    top = (1 << 63) - 1
    a, b = "one two three four five six seven eight", "other words that stand for nothing at all"
    rows = [(top, a), (None, a), (None, b), (None, b), (None, b), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("__id", "__key", "rid", "root")})
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.class_size, r.kept) for r in near.near_duplicates(df).collect()))
    assert got == [(-1, -1, 3, False), (-1, -1, 3, False), (-1, -1, 3, True), (-1, top, 2, False), (3, 3, 2, False), (3, 3, 2, True), (top, top, 2, True)]
    stay = near.near_dedup(df)
    assert stay.columns == df.columns and stay.count() == 3 and stay.where("`__id` = 7 and `__key` = 7").count() == 3


@pytest.mark.parametrize("rounds", [0, 4])
def test_a_large_family_keeps_every_link(spark, rounds, monkeypatch):
    """Chains, a dense group and loners in one family, by pivots and by pages, against all pairs."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a chain: neighbours are near, the ends are not
        rows.append((i, " ".join(base[i : i + 60] + [f"c{j}" for j in range(40)])))
    for i in range(40):  # a dense group
        words = base[:100].copy()
        words[int(rng.integers(0, 100))] = f"z{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:30] + [f"q{i}_{j}" for j in range(25)])) for i in range(10)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    roots = near._roots(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))
    want = {(rows[i][0], rows[r][0]) for i, r in enumerate(roots.tolist())}
    units = near.near_classes.__globals__["_large_links"]
    monkeypatch.setattr(near, "_large_links", lambda *a: units(*a, rounds=rounds, pivots=2))
    # all in one family, whatever the bands say
    monkeypatch.setattr(near, "band_keys", lambda sig: np.zeros((len(sig), 1), np.uint64))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.class_id) for r in near.near_duplicates(df, family=10, page=16).collect()}
    assert got == want
