"""The line field: segments and pieces change nothing, huge texts stay within bounded memory."""

import resource

import numpy as np
import pyarrow as pa
import pytest

from climext.llm import labels, quality
from climext.llm.common import string_buffers

TEXTS = ["", "Hello World! foo foo bar\n\nBAR bar | $ x\nHello World! foo foo bar", "é É É\n" + "word " * 300 + "\n" + "x" * 700 + " y y\n", "", "a\n" * 900]


@pytest.mark.parametrize("segment", [1, 2, 7, 64])
def test_segments_of_chains(segment):
    rng = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2, 3], [1, 37, 5, 200])
    node, edge = 2 * rng.normal(size=len(doc)), rng.normal(size=(2, 2))
    for whole, cut in zip(quality.Chains(doc).marginals(node, edge), quality.Chains(doc, segment).marginals(node, edge), strict=True):
        assert np.allclose(whole, cut)


@pytest.mark.parametrize("piece", [50, 128, 513])
def test_pieces_of_texts(piece):
    for t in TEXTS:
        raw, offsets = string_buffers(pa.array([t]))
        assert (quality.line_features(raw, offsets).bins == quality.line_features(raw, offsets, piece).bins).all()
    x = quality.line_features(*string_buffers(pa.array(TEXTS)))
    apart = [quality.line_features(*string_buffers(pa.array([t]))).bins for t in TEXTS]
    assert (x.bins == np.concatenate(apart)).all()
    w = np.random.default_rng(1).normal(size=quality.N_WEIGHTS)
    assert np.allclose(quality.node_scores(x, w), w[quality.active_features(x)].sum(axis=1))


@pytest.mark.parametrize("text", ["lorem ipsum dolor sit amet " * 2_000_000, "x" * 50_000_000, "short line of text 12\n" * 1_000_000])
def test_huge_texts(text):
    """50 MB on one line, 50 MB in one word, a million lines: under 400 MB besides the text."""
    model = quality.Model(np.linspace(-1, 1, quality.N_WEIGHTS), np.eye(2))
    array = pa.array([text])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _, _, x in quality._blocks(array):
        good, _, _ = quality.Chains(x.doc).marginals(quality.node_scores(x, model.weights), model.edge)
        assert 0 <= good.min() and good.max() <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_disagreeing_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(30)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i in range(30) for y in (1, 0)], "doc_id long, quality int")
    got = {tuple(r) for r in labels.training_rows(docs, marks, "quality", 100).collect()}
    again = {tuple(r) for r in labels.training_rows(docs.repartition(7), marks.repartition(5), "quality", 100).collect()}
    assert got == again and {y for *_, y in got} == {0} and len({t for _, t, _ in got}) == len(got)
