"""Bounded, repeatable samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import settled


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the identifier's text leaves 1 when divided by 3; such rows teach nothing. Null: false."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, classes: tuple[int, ...] = (0, 1), skip_held_out: bool = True) -> DataFrame:
    """(doc_id, label, text) of at most `per_class` labelled documents of each class, chosen by a hash of the identifier.

    The chosen identifiers, at most `per_class` for each class, are broadcast; the texts stay in the shared folder.
    """
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    if skip_held_out:
        known = known.where(~held_out())
    chosen = None
    for value in classes:
        part = known.where(F.col("label") == value).groupBy("doc_id", "label").agg(F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return settled(texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id"))
