"""A bounded sample of labelled documents, for fitting the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, where: Column | None = None, label: str = "quality") -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents, the ones whose ids have the least hashes.

    Only ids and labels are sorted. The chosen ids are broadcast: there are no more than `rows` of them. Unlabelled
    and null rows are left out; where labels disagree about a document, the smaller one holds. Where several rows have
    one doc_id, the text of the least hash stands for it: there is one row for an id.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a hash is kept for each id and task before anything is moved
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text"))
    least = found.groupBy("doc_id").agg(F.min("h").alias("h"))
    one = found.join(F.broadcast(least), ["doc_id", "h"])
    return one.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y"))  # equal texts and hashes, of at most `rows` ids
