"""Training rows for the classifiers: labels outside the held-out third, bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents that are not held out, chosen by a hash of the id.

    One row per distinct text, so that copies of one labelled document don't count as many: that of the least id;
    of labels that disagree the smaller one counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # the ids are bounded by ``most``
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "y")).alias("first"))
    return first.select("first.doc_id", "text", "first.y")
