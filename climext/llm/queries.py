"""The thin queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact, near, packing, pieces, quality, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.raw_transcripts(table(spark, sf_dir, "conversations"))
    turns = chat.parse(raw, chat.train(raw))
    return turns.select("conv_id", "turn", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def op5_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_matrices(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select(
        "shard",
        "row",
        "n_tokens",
        "doc_ids",
        "piece_starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("chain")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_certified(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_nearest_neighbours, op3_quality_classifier, op4_chat_turns, op5_packed_matrices, op6_exact_dedup, op7_minhash_near_dedup, op8_sampled_pieces, op9_substring_dedup, op10_best_fit_packing)}

ORACLES = {
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
               sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op9_substring_dedup": r"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
        g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
        f AS MATERIALIZED (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM g)
            WHERE r > 1),
        c AS (SELECT DISTINCT doc_id, i + o AS j FROM f, range(20) AS t(o)),
        u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
        k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n
              FROM u ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
}
