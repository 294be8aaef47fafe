"""Bounded samples of labelled documents for the two trained scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of the rows of at most ``rows`` labelled ids outside the held-out fold; ``bounded`` limits the rows of repeated ids.

    The sample is the ids of least hash: the same on every run, with no regard
    to label or text. Ids labelled both ways count as 1. The join broadcasts the
    sampled ids, of which there are at most ``rows``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(label)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def bounded(described: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the described rows (doc_id, y, x): those of least hash. An id may bring many rows, so the bound is set after the join."""
    return described.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(rows)
