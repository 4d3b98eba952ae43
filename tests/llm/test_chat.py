"""The hidden Markov model against all state paths."""

import itertools

import numpy as np
import pytest

from climext.llm import chat


def _model(rng):
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]) if len(shape) > 1 else rng.dirichlet(np.ones(shape[0])))
    return chat.Model(draw(chat.S), draw(chat.S, chat.S), tuple(draw(chat.S, n) for n in chat._FEATURES))


def _brute(model, shown, entry=None, last=None):
    def score(path):
        total = (model.start[path[0]] if entry is None else model.move[entry, path[0]]) + shown[0][path[0]]
        return total + sum(model.move[a, b] + shown[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False)))

    paths = [p for p in itertools.product(range(chat.S), repeat=len(shown)) if last is None or p[-1] == last]
    return list(max(paths, key=score))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    model = _model(rng)
    features = [tuple(int(rng.integers(0, n)) for n in chat._FEATURES) for _ in range(5)]
    shown = model.emissions(features)
    assert chat.viterbi(model, shown) == _brute(model, shown)
    for entry, last in ((0, None), (None, 3), (4, 1)):
        assert chat.viterbi(model, shown, entry, last) == _brute(model, shown, entry, last)


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_blocks_joined_by_transfer_matrices(cut):
    """Two blocks: the borders that the matrices give, then each block between them, make the best whole path."""
    rng = np.random.default_rng(7)
    model = _model(rng)
    shown = model.emissions([tuple(int(rng.integers(0, n)) for n in chat._FEATURES) for _ in range(5)])
    first, _ = chat.transfer(model, shown[:cut])
    _, between = chat.transfer(model, shown[cut:])
    both = first[:, None] + between
    last = int(both.max(axis=0).argmax())
    middle = int(both[:, last].argmax())
    got = chat.viterbi(model, shown[:cut], None, middle) + chat.viterbi(model, shown[cut:], middle, last)
    assert got == _brute(model, shown)


def test_names_that_clash(spark):
    talk = [(1, i, r, t) for i, (r, t) in enumerate([("system", "Be kind."), ("user", "Hi?"), ("assistant", "Hello.\nHow are you?"), ("user", "Fine.")])]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    raw = chat.raw_transcripts(df)
    model = chat.train(raw)
    from pyspark.sql import functions as F

    plain = {tuple(r) for r in chat.parse(raw, model).collect()}
    odd = raw.withColumns({c: F.lit(7) for c in ("coarse", "fine", "key", "block", "task", "local", "content", "b", "c")})
    assert {tuple(r) for r in chat.parse(odd, model).collect()} == plain
