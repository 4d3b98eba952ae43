"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climext.llm import exact, near, packing, quality, substring
from climext.llm.common import bookmark, discard, materialize, wrapped
from climext.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good (score of 0.5 or more); it learns from the tables in ``sf_dir``."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    inner, back = wrapped(docs)
    return back(quality.score(inner, model, "__quality").where(F.col("__quality") >= 0.5))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    inner, back = wrapped(docs)
    return back(exact.exact_dedup(inner))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least doc_id."""
    return near.near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts that lose nothing stay as they are, emptied ones go."""
    inner, back = wrapped(docs)
    cut = substring.cut_repeats(inner)
    n = F.when(F.col("n_removed") > 0, F.char_length("kept_text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = cut.where("n_removed = 0 or n_removed < n_words").withColumns({"text": text, "__n": n})
    if "n_chars" in docs.columns:
        chars = F.coalesce(F.col("__n").cast(docs.schema["n_chars"].dataType), F.col("__rest.n_chars"))
        changed = changed.withColumn("__rest", F.col("__rest").withField("n_chars", chars))
    return back(changed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece and its place in a sequence of 4096 ids."""
    return packing.pack_certified(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: A learned classifier and a public tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder goes once its rows are written."""
    docs, begun = table(spark, sf_dir, "documents"), bookmark(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name.replace(' ', '-')}")
            discard(spark, begun, but=1)
    return docs
