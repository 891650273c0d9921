"""Folds and bounded training samples of labelled documents, for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2
FOLDS = 4


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves the held-out remainder; a null id is in no fold."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids outside the held-out fold, the same ids every time.

    Only the sample's ids are bounded; they find their texts by a join whose small side has ``most`` rows at most, so
    the corpus is not shuffled. Ids with contradicting labels and null ids or labels are left out.
    """
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = agreed.orderBy(order, "doc_id").limit(most).select("doc_id", F.col("label").cast("double").alias("label"))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
