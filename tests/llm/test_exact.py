"""The extendible-hash index: its directory, owners, pages and chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext.llm import exact


def test_directory_doubles_where_buckets_are_overfull():
    rng = np.random.default_rng(0)
    leaves = {int(s): (int(n), 10 * int(n)) for s, n in zip(range(64), rng.integers(0, 30, 64), strict=True) if n}
    leaves[37] = (500, 5000)
    buckets, owners = exact.split_buckets(leaves, 6, 100, 10_000)
    low = [(s << (6 - d), (s + 1) << (6 - d)) for d, s, _, _ in buckets]
    assert all(a[1] <= b[0] for a, b in zip(low, low[1:], strict=False))  # in key order, none twice
    load = np.zeros(owners)
    for (lo, hi), (d, _, first, pages) in zip(low, buckets, strict=True):
        n = sum(leaves.get(x, (0, 0))[0] for x in range(lo, hi))
        assert (n <= 100) == (pages == 1) and (pages == 1 or d == 6)
        load[first : first + pages] += n / pages
    assert load.max() <= 100 and sum(x for x, _ in leaves.values()) == round(load.sum())
    assert exact.split_buckets({}, 6, 100, 100) == ([], 0)
    # bytes count as rows do
    assert exact.split_buckets({0: (3, 3000)}, 2, 100, 1000)[0] == [(2, 0, 0, 3)]


def test_the_directory_places_rows(spark):
    """Rows whose slot no bucket has would be lost: the index is what gives the result."""
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(400)], "doc_id long, text string")
    made = exact._directory
    exact._directory = lambda *a: (made(*a)[0].where("__slot < 32768"), *made(*a)[1:])
    try:
        assert 0 < exact.exact_groups(df, bucket_rows=20).count() < 400
    finally:
        exact._directory = made
    assert exact.exact_groups(df, bucket_rows=20).count() == 400


@pytest.mark.parametrize("bits", [64, 3, 1])
@pytest.mark.parametrize("rows", [5000, 7])
def test_hot_copies_chains_and_least_ids(spark, bits, rows):
    low = -(1 << 63)
    data = [(i, "hot") for i in range(60)] + [(low, "a"), (None, "a"), (None, "b"), (low, "c"), (low, "c"), (None, None), (None, None)]
    data += [(100 + i, f"t{i % 9}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = exact.exact_groups(df, bucket_rows=rows, hash_bits=bits, max_depth=4).collect()
    want: dict[str, list] = {}
    for i, t in data:
        want.setdefault(t or "", []).append(i)
    assert len(got) == len(data) and sum(r.kept for r in got) == len(want)
    import hashlib

    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    if bits == 1:  # two keys at most
        assert len(want) // 2 - 1 <= max(r.chain for r in got) < len(want)
    stay = exact.exact_dedup(df.withColumn("__slot", F.lit(1)), bucket_rows=rows)
    assert stay.columns == ["doc_id", "text", "__slot"] and stay.count() == len(want)
