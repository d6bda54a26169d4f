"""Chunks of documents with offsets, and vector top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: By how much two sums of one product may differ.
SPARE = 1e-9


def _split_long(pattern: str, limit: int):
    return lambda p: F.when(F.char_length(p) <= limit, F.array(p)).otherwise(F.split(p, pattern))


def _pieces(text: Column, limit: int) -> Column:
    """Pieces of at most `limit` characters in order: whole paragraphs, else sentences, else words, else runs of characters."""
    out = F.array(text)
    for pattern in (r"(?<=\n)(?=[^\n])", r"(?<=[.!?…]\s)", r"(?<=\s)(?=\S)"):
        out = F.flatten(F.transform(out, _split_long(pattern, limit)))
    return F.flatten(F.transform(out, lambda p: F.when(F.char_length(p) <= limit, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(f"((?s).{{1,{limit}}})"), 1))))


def chunk(docs: DataFrame, target: int = 450, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_id, start, end, text, token_count) of docs (doc_id, text).

    Tokens are taken as four characters. Pieces are packed in order to at most `target` tokens: a piece's place in a
    running count of characters says which chunk it is in. A chunk is a slice of the text by offsets, reaches `overlap`
    tokens into the next one, and blank chunks are left out; so nothing is lost and equal chunks keep their own places.
    """
    limit = 4 * target
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.transform(_pieces(F.col("text"), limit), lambda p: F.char_length(p)).alias("n"))
    start = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))

    def step(done: Column, n: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), (last["end"] + n).alias("end"))
        fits = last["end"] + n - last["start"] <= limit
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(last["end"].alias("start"), (last["end"] + n).alias("end")))))

    rows = pieces.select("doc_id", "text", F.posexplode(F.aggregate("n", start, step)).alias("i", "c"))
    order = Window.partitionBy("doc_id").orderBy("i")
    to = F.least(F.col("c.end") + 4 * overlap, F.coalesce(F.lead("c.end").over(order), F.col("c.end")))
    rows = rows.select("doc_id", "i", F.col("c.start").alias("start"), to.alias("end"), F.substring("text", F.col("c.start") + 1, to - F.col("c.start")).alias("text"))
    rows = rows.where(F.btrim("text") != "")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_id"), "start", "end", "text", F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).cast("int").alias("token_count"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def top_chunks(queries: DataFrame, chunks: DataFrame, k: int = 3, block: int = 4096) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k chunks most like each query, best first, ties by chunk_id.

    queries (query_id, vector) are a stated set, read against all chunks (chunk_id, vector) in blocks of about `block`
    queries, which are sent to the tasks one block after another. A task multiplies matrices and hands on, for each query,
    what may be among the k best of its rows. Rows without a vector are left out.
    """
    asked = queries.where("vector is not null").select("query_id", "vector")
    blocks = max(1, -(-asked.count() // block))
    kinds = {c: dict(df.dtypes)[c] for c, df in (("query_id", queries), ("chunk_id", chunks))}
    parts = [_near(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), chunks, k, kinds) for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unit(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length; those without length stay zero."""
    rows = np.array(vectors.to_pylist(), np.float64).reshape(len(vectors), -1 if len(vectors) else 0)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def products(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """q[row] · v[col], summed in an order that the vectors' length alone decides, so that equal vectors have equal products."""
    out = np.empty(len(row))
    for lo in range(0, len(row), 65_536):
        at = slice(lo, lo + 65_536)
        out[at] = (q[row[at]] * v[col[at]]).sum(axis=1)
    return out


def _near(asked: DataFrame, chunks: DataFrame, k: int, kinds: dict[str, str]) -> DataFrame:
    got = asked.toArrow()
    sent = asked.sparkSession.sparkContext.broadcast((got["query_id"].combine_chunks(), unit(got["vector"])))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        least = np.full(len(q), -np.inf)  # of each query a similarity that k rows reach
        for part in parts:
            for lo in range(0, part.num_rows if len(q) else 0, 1000):
                p = part.slice(lo, 1000)
                v = unit(p.column(1))
                like = q @ v.T
                if p.num_rows >= k:
                    least = np.maximum(least, np.partition(like, p.num_rows - k, axis=1)[:, p.num_rows - k] - SPARE)
                row, col = np.nonzero(like >= least[:, None])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), p.column(0).take(pa.array(col)), pa.array(products(q, v, row, col))], names=["query_id", "chunk_id", "similarity"])

    return chunks.where("vector is not null").select("chunk_id", "vector").mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double")
