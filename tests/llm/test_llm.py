"""The training-data operators against brute force, round trips and held-out labels, and on unusual input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from climext.llm import ann, chat, exact, near, packing, pieces, quality, queries, substring, toxicity

SF = "/root/testdata/sf0.001"
VOCABULARY = queries.vocabulary("word_bpe_49k.json")
PIECES = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empties, a long text, repeated rows, and clashing column names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(40):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        rows.append((i, f"{body} {passage} tail{i}" if i % 4 == 0 else body))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    rows += [(120 + i, rows[7][1] + f" extra{i}" if len(rows[7][1].split()) > 60 else passage + f" y{i}") for i in range(4)]
    rows += [(140, None), (141, ""), (142, " \t\n"), (None, "odd id text"), (143, " ".join(words * 20)), (144, "über ßtraße 你好 ▁ naïve"), (2, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("rank", "n", "key", "band", "start", "found", "copy", "score", "length", "class_id")
    return df.withColumns({c: F.lit(7) for c in names}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def order(i):
    return float("inf") if i is None else i


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, empty, bits):
    rows = texts(docs)
    got = exact.exact_groups(docs, hash_bits=bits, bucket_rows=5).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(-1 if i is None else i)
    for r in got:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and (-1 if r.keep_id is None else r.keep_id) == max(group)
    assert sum(r.kept for r in got) == len(by)
    stay = exact.exact_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(by)
    assert exact.exact_groups(empty).count() == 0


def brute_cut(rows, k):
    rows = sorted(rows, key=lambda r: (order(r[0]), r[1]))
    seen, out = set(), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [500, 2])
def test_substring(docs, empty, hot):
    base = docs.dropDuplicates(["doc_id", "text"])
    want = brute_cut(texts(base), 20)
    got = substring.cut_repeats(base, hot=hot, shard_words=500).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
    assert substring.cut_repeats(docs).count() == docs.count()
    assert substring.cut_repeats(empty).count() == 0


def brute_near(rows, threshold):
    def units(t):
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", t.lower())
        out = {}
        for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
            out[s, out.get((s, "n"), 0)] = 1
            out[s, "n"] = out.get((s, "n"), 0) + 1
        return {k for k in out if k[1] != "n"}

    rows = sorted(rows, key=lambda r: order(r[0]))
    sets = [units(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) >= threshold * union:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(r[0], r[1]): rows[find(i)][0] for i, r in enumerate(rows)}


@pytest.mark.parametrize("family", [256, 2])
def test_near(docs, empty, family):
    want = brute_near(texts(docs), 0.8)
    got = near.near_duplicates(docs, family=family, page=2).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, c) for (i, _), c in want.items()}
    stay = near.near_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(set(want.values()))
    assert near.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    doc = np.repeat([0, 1], [len(a), len(b)])
    sig = near.dart_signatures(doc, np.concatenate([a, b]), np.ones(len(doc)), 2, 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(300 / 500, abs=0.05)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    got = packing.pack_certified(docs, VOCABULARY, capacity=64, partition_bins=8).collect()
    ids = [(i, tok.encode(t, add_special_tokens=False).ids + [1]) for i, t in texts(docs)]
    want = sorted((order(i), s // 64, s, len(x[s : s + 64]), zlib.crc32(np.asarray(x[s : s + 64], "<u4").tobytes())) for i, x in ids for s in range(0, len(x), 64))
    assert sorted((order(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(w[3] for w in want)
    assert -(-total // 64) <= len(bins) <= 1.15 * total / 64 + 8
    assert packing.pack_certified(empty, VOCABULARY).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 41, rng.integers(1, 60))
        where, offset, bins = packing.best_fit_decreasing(x, 40)
        assert np.bincount(where, x).max() <= 40 and np.ceil(packing.dual_feasible_bound(x, 40) - 1e-9) <= bins
    assert packing.dual_feasible_bound(np.full(5, 30), 40) == 5


def test_matrices(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    back = {}
    for r in packing.packed_matrices(docs, VOCABULARY, capacity=128, window_tokens=700).collect():
        positions = np.frombuffer(r.position_ids, "<u2")
        for d, s, x, a in zip(r.doc_ids, r.piece_starts, packing.read_row(r.ids, r.cu_seqlens), r.cu_seqlens, strict=False):
            assert positions[a : a + len(x)].tolist() == list(range(len(x)))
            back.setdefault(d, []).append((s, x.tolist()))
    for i, t in texts(docs):
        if i not in (2, 100):
            assert [v for _, x in sorted(back[i]) for v in x] == tok.encode(t, add_special_tokens=False).ids + [49407]
    assert packing.packed_matrices(empty, VOCABULARY).count() == 0


def test_pieces(docs, empty):
    a = pieces.encode(docs, PIECES)
    got = pieces.decode(a, PIECES).collect()
    assert all(r.decoded == r.text for r in got) and len(got) == docs.count()
    key = lambda df: sorted((order(r.doc_id), r.text, bytes(r.ids)) for r in df.collect())
    assert key(a) == key(pieces.encode(docs.repartition(5, "text"), PIECES))
    assert key(a) != key(pieces.encode(docs, PIECES, seed=2))
    assert pieces.encode(empty, PIECES).count() == 0


def test_sampling_follows_posterior():
    v = pieces.vocabulary(PIECES, 1.5)
    text = b" the"
    raw = np.frombuffer(text * 4000, np.uint8)
    offsets = np.arange(4001) * len(text)
    ids, counts = pieces.sample_block(v, raw, offsets, np.arange(4000), 1)
    starts = np.cumsum(counts) - counts
    weights = {}

    def walk(at, log, path):
        if at == len(text):
            weights[path] = np.exp(log)
        for i, p in enumerate(v.bytes):
            if v.len[i] and text.startswith(p, at):
                walk(at + len(p), log + v.weight[i], (*path, i))

    walk(0, 0.0, ())
    total = sum(weights.values())
    seen = [tuple(ids[s : s + n].tolist()) for s, n in zip(starts, counts, strict=True)]
    best = max(weights, key=weights.get)
    assert seen.count(best) / 4000 == pytest.approx(weights[best] / total, abs=0.03)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[300:420] = x[300]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4), (1004, [1.0]), (None, [1.0] * 8), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = ann.search(df, lambda i: i % 20 == 0, page=64, leaf=16).collect()
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in mine)
        hits += len({m[1] for m in mine} & {*want.tolist()})
    assert hits >= 0.95 * 300
    few = ann.search(df.where("vec_id < 4"), lambda i: i == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == np.lexsort((np.arange(4)[1:], np.sqrt(((x[1:4] - x[0]) ** 2).sum(axis=1))))[:3].__add__(1).tolist()
    assert ann.search(df.where("false"), lambda i: i == 0).count() == 0


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.85)])
def test_classifiers(spark, docs, empty, module, label, least):
    sf = "/root/testdata/sf0.01"
    table, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = module.train(table, labels)
    scored = module.classify(table, model)
    held = scored.join(labels, "doc_id").where("held_out")
    assert scored.count() == table.count()
    assert held.where(F.col("predicted") == F.col(label)).count() >= least * held.count()
    odd = module.classify(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert module.classify(empty, module.train(empty, labels.where("false"))).count() == 0


def test_deobfuscation():
    words = "stupid idiot people talk about other things while hello world goes there".split() * 50
    counts = np.zeros(toxicity.A**4, np.int64)
    import pyarrow as pa

    for _, _, raw, offsets in toxicity._blocks(pa.array([" ".join(words)])):
        counts += np.bincount(toxicity.context_codes(toxicity.symbols(raw, offsets)), minlength=toxicity.A**4)
    d = toxicity.Decoder(toxicity.language_model(counts))
    assert d.words("1d10t!!!") == ("idiot",) and d.words("stuuuupid") == ("stupid",) and d.words("s.t.u.p.i.d") == ("stupid",)
    assert d.words("hello") == ("hello",) and d.words("...") == ()
    found = next(d.restored(pa.array(["you i d i o t there"])))
    assert "idiot" in found


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    node, edge = rng.normal(size=4), rng.normal(size=(2, 2))
    good, pairs, logz = quality.Chains(np.zeros(4, np.int64)).marginals(node, edge)
    total, want = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = np.exp(sum(n for n, v in zip(node, y, strict=True) if v) + sum(edge[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        want += w * np.asarray(y)
    assert good == pytest.approx(want / total) and logz == pytest.approx(np.log(total)) and pairs.sum() == pytest.approx(3)


def test_chat(spark):
    talks = queries.table(spark, SF, "conversations")
    raw = chat.raw_transcripts(talks).cache()
    model = chat.train(raw)
    turns = chat.parse(raw, model)
    key = lambda df: sorted((order(r.conv_id), r.turn, r.role, r.content, r.n_lines) for r in df.collect())
    assert key(turns) == key(chat.parse(raw, model, block_turns=2, block_rows=3))
    n, right = 0, 0
    gold = {(r.conv_id, r.turn): chat.ROLES[r.gold] for r in raw.collect()}
    for r in turns.collect():
        if (r.conv_id, r.turn) in gold:
            n, right = n + 1, right + (gold[r.conv_id, r.turn] == r.role)
    assert right > 0.8 * n
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "bot", "Hi\nthere")], "conv_id long, turn long, role string, text string")
    assert chat.parse(chat.raw_transcripts(odd), model).count() >= 2
    assert chat.parse(raw.where("false"), chat.train(raw.where("false"))).count() == 0


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "substring dedup", "best-fit packing"]
    base = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = corpus_pipeline.quality_stage(spark, base, SF)
    assert kept.columns == base.columns
    one = corpus_pipeline.exact_stage(spark, base, SF)
    assert one.groupBy(F.coalesce("text", F.lit(""))).count().where("count > 1").count() == 0
    cut = corpus_pipeline.substring_stage(spark, one, SF)
    assert cut.columns == base.columns
    want = {i: x for i, x in brute_cut(texts(one), 20).items()}
    for r in cut.collect():
        n, gone, text = want[r.doc_id]
        assert gone < n or not gone
        assert not gone or (r.text == text and r.n_chars == len(text))
    assert corpus_pipeline.packing_stage(spark, cut, SF).count() >= cut.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
