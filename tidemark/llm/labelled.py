"""Bounded samples of labelled documents, which the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import least_draws


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``fold``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 4, fold: int = 2,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, text, y): the documents of at most ``max_rows`` ids outside the held-out fold, a row an id.

    The ids are drawn first, by a hash, so only the sample's texts are moved. An id with several labels
    counts once, with the larger, and of several texts with the least; null ids and labels are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    drawn = least_draws(known, ["id"], max_rows, 0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")  # max_rows ids at most
