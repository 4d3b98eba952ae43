"""The pipeline's stages on nulls, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASH = ("n_words", "n_removed", "kept_text", "__quality", "__id", "__key", "__none", "__rest", "rid", "score", "key", "start")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(9000))
    body = "This is a plain sentence that says a thing or two about the weather of the day. " * 3
    rows = [(1, body), (1, body), (None, body), (None, None), (2, None), (2, ""), (3, " \n\t"), (4, long), (5, long + " and one more"), (6, "short"), ((1 << 63) - 1, "last one"), (-(1 << 63), "first one")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(77) for c in CLASH} | {"lang": F.lit(None).cast("string")}).repartition(3).cache()


@pytest.mark.parametrize("n", range(4))
def test_columns_survive(spark, odd, n):
    out = corpus_pipeline.STAGES[n][1](spark, odd, SF)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    assert all(r[c] == 77 for r in rows for c in CLASH)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
    if n in (1, 2):  # one row of each class, the empty ones are one class
        texts = [(r.text or "").strip() if n == 2 else r.text or "" for r in rows]
        assert len(texts) == len(set(texts)) == (8 if n == 1 else 6)
    if n == 3:
        assert all(r.text is None or len(r.text) for r in rows if r.doc_id == 2 and r.text)
    again = corpus_pipeline.STAGES[n][1](spark, out, SF)
    assert again.count() <= len(rows)


def test_stages_on_an_empty_table(spark, odd):
    none = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_packing_of_odd_rows(spark, odd):
    got = corpus_pipeline.packing_stage(spark, odd, SF).collect()
    assert len(got) >= odd.count()
    assert sum(r.piece == 0 for r in got) == odd.count()


def test_a_run_leaves_only_what_its_result_needs(spark):
    from climext.llm.common import _written

    before = set(_written(spark))
    out = corpus_pipeline.run(spark, SF)
    left = [p for p in _written(spark) if p not in before]
    assert sum("stage-" in p for p in left) == 1 and not any("signed" in p or "groups" in p for p in left)
    assert out.count() > 0
