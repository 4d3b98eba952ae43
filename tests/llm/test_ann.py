"""The tree's levels, blocks and calibration against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from climext.llm import ann, queries

SF = "/root/testdata/sf0.1"


def test_shared_blocks():
    got = ann.shared_blocks({0: 5, 1: 5, 2: 9, 5: 1, 7: 10}, 10)
    assert [got[x] // ann._PART for x in (0, 1, 2, 5, 7)] == [0, 0, 2, 2, 7]


@pytest.mark.parametrize("how", [{}, {"fit_rows": 100, "page": 64, "leaf": 16, "branch": 4}])
def test_recall_of_the_querys_own(spark, how):
    """At sf0.1, by one tree and by trees inside of overfull leaves: 0.9 of the true neighbours at least."""
    vectors = queries.table(spark, SF, "embeddings").withColumns({c: F.lit(1) for c in ("top", "leaf", "block", "v", "score")})
    mine = lambda i: i % 100 == 0
    index = ann.build_index(vectors, **how)
    assert (index.trees is None) == (not how)
    asked = index.placed.where(mine(F.col("vec_id")))
    found = ann.search_index(index, asked, page=how.get("page", 4096)).cache()
    assert found.count() == 10 * asked.count()
    assert ann.recall_of(found, vectors, mine) >= 0.9
    assert ann.scanned_share(index, asked, page=how.get("page", 4096)) < 0.85


def test_the_share_scanned_falls(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 8)) * 3
    x = np.repeat(centres, 160, axis=0) + rng.normal(size=(16_000, 8)) * 0.5
    rng.shuffle(x)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    shares = []
    for n in (1000, 16_000):
        index = ann.build_index(df.where(F.col("vec_id") < n), fit_rows=500, page=64, leaf=8, branch=8)
        shares.append(ann.scanned_share(index, index.placed.where("vec_id % 100 = 0"), page=64))
    assert shares[1] < 0.7 * shares[0], shares


def test_copies_in_a_tree_of_their_own(spark):
    x = np.random.default_rng(4).normal(size=(900, 4))
    x[300:] = x[300]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, None), (0, [9.0] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit(1))
    got = ann.search(df, lambda i: i % 100 == 0, page=100, fit_rows=200, leaf=8, branch=4).toPandas()
    for q in (300, 400, 800):
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == [i for i in range(300, 312) if i != q][:10] and (mine["score"] == 0).all()
