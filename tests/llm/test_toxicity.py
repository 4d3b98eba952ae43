"""Lattices by enumeration, white space as a separator, texts of any size."""

import itertools
import resource

import numpy as np
import pyarrow as pa
import pytest

from climext.llm import toxicity

WORDS = "stupid idiot people talk about other things while hello world goes there moron".split()


@pytest.fixture(scope="module")
def decoder():
    counts = np.zeros(toxicity.A**4, np.int64)
    for _, _, raw, offsets in toxicity._blocks(pa.array([" ".join(WORDS * 50)])):
        counts += np.bincount(toxicity.context_codes(toxicity.symbols(raw, offsets)), minlength=toxicity.A**4)
    return toxicity.Decoder(toxicity.language_model(counts))


def brute(decoder, lattice):
    """Best reading over all paths, each scored on its own."""
    lm, a = np.asarray(decoder.lm).reshape(-1, toxicity.A), toxicity.A
    best = None
    for path in itertools.product(*lattice):
        score, context, out = 0.0, 0, []
        for s, cost in (*path, (0, 0.0)):
            score -= cost
            if s == 0:
                score += lm[context, 0] if context else 0.0
                out += [] if context == 0 else [0]
                context = 0
            elif s > 0:
                score += lm[context, s]
                context = (context % (a * a)) * a + s
                out.append(s)
        if best is None or score > best[0] + 1e-9:
            best = (score, "".join(chr(96 + s) if s else " " for s in out).split())
    return best[1]


@pytest.mark.parametrize("text", ["1d10t", "st u p1d", "stuup1d", "s.t-u", "m0r0n!", "h3ll0", "id iot", "w0r|d", "go es", "pe0 ple"])
def test_viterbi_is_the_best_of_all_paths(decoder, text):
    assert decoder.viterbi(decoder.options(text)) == brute(decoder, list(decoder.options(text)))


def test_settled_parts_change_nothing(decoder):
    text = " ".join(["1d10t stuupid he11o w0rld s.t.u.p.i.d"] * 20)
    assert decoder.viterbi(decoder.options(text)) == decoder.viterbi(decoder.options(text), most=9)


def test_white_space_inside_words(decoder):
    for text, word in (("you stu pid there", "stupid"), ("an i d iot there", "idiot"), ("so st upid of", "stupid"), ("a m0 r on!", "moron"), ("the pe op le talk", "people")):
        joined = np.asarray(sorted({toxicity.word_hash(w) for w in WORDS}), np.uint64)
        for how in (None, joined):
            assert word in next(decoder.restored(pa.array([text]), joined=how)), (text, how is None)
        assert word not in next(decoder.restored(pa.array([text]), joined=np.zeros(0, np.uint64)))
    # where the words are words of their own, they stay
    assert {"goes", "there"} <= next(decoder.restored(pa.array(["it goes there"]), joined=None))


def test_parts_of_a_long_text(decoder, monkeypatch):
    text = "things about i d i o t while stu pid people and s t u p i d talk " * 40
    joined = np.asarray([toxicity.word_hash("stupid")], np.uint64)
    whole = next(decoder.restored(pa.array([text]), joined=joined))
    monkeypatch.setattr(toxicity, "PIECE", 97)
    assert next(decoder.restored(pa.array([text]), joined=joined)) == whole and {"idiot", "stupid"} <= whole


@pytest.mark.parametrize("text", ["plain words of a long text " * 700_000, "qwertzuiop" * 150_000])
def test_huge_texts(decoder, text):
    array = pa.array([text, "short one"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    wanted = toxicity.Wanted(["plain", "^idio"])
    got = list(decoder.restored(array, wanted.joined, wanted))
    assert len(got) == 2 and got[0] == ({"plain"} if "plain" in text else set())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_tokens_that_are_left_out_yield_nothing(decoder):
    rng = np.random.default_rng(6)
    wanted = toxicity.Wanted(["idiot", "^stup", "moron#2", "good", "hello"])
    letters = "abcdefghilmnoprstu01!.,"
    tokens = ["".join(rng.choice(list(letters), rng.integers(1, 8))) for _ in range(2000)]
    tokens += ["idiot,", "(stupid)", "iiidiott", "moron", "goood", "stuuupidity", "1d10t!!", "hell\u00a0hello", "g", "gd", "st", "\u00a0idiot", "\u00edd\u00ef\u00f3t", "st\u00fcp\u00efd", "\u00e9\u00e9", "\u4f60idiot", "na\u00efve", "\u00dfst\u00fb", "\u00e9 id"]
    for x in tokens:
        every = {w for w in next(decoder.restored(pa.array([x]), np.zeros(0, np.uint64))) if wanted.has(w)}
        assert next(decoder.restored(pa.array([x]), np.zeros(0, np.uint64), wanted)) == every, x
