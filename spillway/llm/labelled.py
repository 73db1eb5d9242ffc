"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import documents, table

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, by a checksum of the id as text; such rows are never learned from. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label``: at most ``max_rows`` labelled rows outside the held-out fold, the same at every run, as a table.

    Ids repeated in ``labels`` count once, with the highest label, and ids repeated in ``docs`` with their first text; null ids and labels don't count. The ids, bounded by
    ``max_rows``, are broadcast, so that texts are not moved.
    """
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = table(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labels")
    # An id that many rows have gives one row: combined before the shuffle, and dealt by id, so that no task gets all texts.
    rows = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    return table(rows.agg(F.min("text").alias("text"), F.first("label").alias("label")), "labelled")
