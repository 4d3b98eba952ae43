import numpy as np
import pyarrow as pa

from climext.llm import ann, packing, queries, toxicity


def test_a_query_in_a_small_leaf_finds_k(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.repeat(rng.normal(size=(40, 4)), 20, axis=0), [[50.0, 50.0, 50.0, 50.0]]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = [r.asDict() for r in ann.search(df, lambda i: i % 100 == 0, branch=2, leaf=2).orderBy("query_id", "rank").collect()]
    assert [(r["query_id"], r["rank"]) for r in got] == [(q, n) for q in range(0, 801, 100) for n in range(1, 11)]
    # the nearest of the leaves visited: those of the lone vector hold whole groups of copies
    lone = [r for r in got if r["query_id"] == 800]
    assert all(np.isclose(r["score"], np.sqrt(((x[r["vec_id"]] - x[800]) ** 2).sum())) for r in lone)
    few = ann.search(df.where("vec_id in (0, 20, 800)"), lambda i: i == 800, branch=2, leaf=2)
    assert few.count() == 2


def test_spaced_runs_count_characters_and_allow_separators():
    texts = ["you s. t. u. p. i. d there", "a £ ¡ b", "x € y z", "ab s- t· u, cd", "no run a b here", "", "it is € 5 so"]
    want = ["s. t. u. p. i. d", "a £ ¡ b", "x € y z", "s- t· u,", None, None, None]
    for _, _, raw, offsets in toxicity._blocks(pa.array(texts)):
        data, spans = raw.tobytes(), toxicity._spaced_runs(raw, toxicity.Tokens(raw, offsets, ~toxicity.SPACE, hashes=False))
        got = [[data[a:z].decode() for a, z in spans.get(d, [])] for d in range(len(texts))]
    assert got == [[w] if w else [] for w in want]


def test_spaced_words_with_separators_and_lookalikes_are_restored():
    words = "stupid idiot people talk about other things while hello world goes there".split() * 50
    counts = np.zeros(toxicity.A**4, np.int64)
    for _, _, raw, offsets in toxicity._blocks(pa.array([" ".join(words)])):
        counts += np.bincount(toxicity.context_codes(toxicity.symbols(raw, offsets)), minlength=toxicity.A**4)
    d = toxicity.Decoder(toxicity.language_model(counts))
    for text, word in (("you s. t. u. p. i. d there", "stupid"), ("you \u00a1 d \u00a1 o t there", "idiot"), ("you p \u20ac o p l \u20ac there", "people")):
        assert word in next(d.restored(pa.array([text]))), text


def test_certificates_are_of_what_a_partition_holds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate(rng.integers(5, 45, 300).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_certified(df, queries.vocabulary("word_bpe_49k.json"), capacity=64, partition_bins=8, slack=0.0).toPandas()
    assert len(got) == 300
    for _, part in got.groupby(got["sequence_id"].to_numpy() >> 32):
        assert set(part["partition_bins"]) == {part["sequence_id"].nunique()}
        assert set(part["partition_bound"]) == {int(np.ceil(packing.dual_feasible_bound(part["length"].to_numpy(), 64) - 1e-9))}
