"""Exchanges that save sequences, certificates, and packed matrices on disk."""

import numpy as np

from climext.llm import packing, queries

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def test_an_exchange_saves_sequences(spark):
    """Partitions that can't fill their bins alone do together; all pieces stay, and no bound is broken."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate(rng.integers(20, 44, 400).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = {"capacity": 64, "partition_bins": 8, "slack": 0.0}
    once, more = (packing.pack_certified(df, VOCABULARY, rounds=r, **how).toPandas() for r in (0, None))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, once[key].to_numpy().tolist())) == sorted(map(tuple, more[key].to_numpy().tolist()))
    lengths = more["length"].to_numpy()
    least = int(np.ceil(packing.dual_feasible_bound(lengths, 64) - 1e-9))
    assert least <= more["sequence_id"].nunique() < once["sequence_id"].nunique()


def test_written_matrices_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["some words"] * n)) for i, n in enumerate(rng.integers(0, 90, 120).tolist())] + [(120, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = packing.packed_matrices(df, VOCABULARY, capacity=64, window_tokens=900).cache()
    packing.write_packed(made, str(tmp_path / "m"))
    back = packing.read_packed(spark, str(tmp_path / "m"))
    key = lambda d: sorted((r.shard, r.row, r.n_tokens, tuple(r.doc_ids), tuple(r.cu_seqlens), bytes(r.ids), bytes(r.position_ids)) for r in d.collect())
    assert key(back) == key(made)
    assert made.select("shard", "row").distinct().count() == made.count()
    assert {d for r in back.collect() for d in r.doc_ids} == set(range(121))
