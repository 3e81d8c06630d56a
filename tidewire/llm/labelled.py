"""A bounded, repeatable sample of labelled documents on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import slim


def held_out(id_col: Column) -> Column:
    """Rows whose CRC-32 of the id as text leaves 1 when divided by 3; no label of theirs is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, learn: Column | None = None) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``per_class`` rows of each label 0 and 1, by the order of a hash.

    The bound makes the sample small enough to broadcast against the documents and to fit a model on one
    machine, whatever the number of labels. Rows with a null label or id are passed over, and of an id that
    is labelled twice the larger label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    return slim(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
