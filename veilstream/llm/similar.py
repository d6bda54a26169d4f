"""Pairs of texts verified on the words of their full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import cut

#: Bytes of text that are compared at a time; one pair is compared whole, however long.
AT_ONCE = 1 << 22


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for p in parts:
        for lo, hi, texts in H.batches(p.column(2)):
            yield pa.RecordBatch.from_arrays([p.column(0)[lo:hi], p.column(1)[lo:hi], pa.array([press.compress(t.lower()) for t in texts], pa.binary())], names=["doc_id", "tag", "z"])


def packed(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc, z): the compressed text in lower case of each of `numbers` (doc, doc_id, tag), from texts (doc_id, tag, text)."""
    shape = "doc_id long, tag long, z binary"
    found = texts.where("doc_id is not null").mapInArrow(_pack, shape).join(numbers, ["doc_id", "tag"]).select("doc", "z")
    return found.dropDuplicates(["doc"])  # equal rows occur


def _verify(size: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for p in parts:
            a, b, za, zb = (p.column(k) for k in range(4))
            keep = np.zeros(p.num_rows, bool)
            a_, b_ = a.to_pylist(), b.to_pylist()
            lo = 0
            while lo < p.num_rows:
                held: dict[int, bytes] = {}
                bytes_, hi = 0, lo
                while hi < p.num_rows and (hi == lo or bytes_ < AT_ONCE):
                    for ids, z in ((a_, za), (b_, zb)):
                        if ids[hi] not in held:
                            held[ids[hi]] = opener.decompress(z[hi].as_py())
                            bytes_ += len(held[ids[hi]])
                    hi += 1
                sets = dict(zip(held, H.exact_shingles(list(held.values()), size), strict=True))
                for i in range(lo, hi):
                    x, y = sets[a_[i]], sets[b_[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                lo = hi
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, numbers: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of numbers whose full shingle sets are similar enough. Only texts that stand in a pair are moved."""
    pairs = cut(pairs.select("a", "b"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(numbers.select("doc", "doc_id", "tag"), "doc")
    z = cut(packed(texts, named))
    one, two = z.select(F.col("doc").alias("a"), F.col("z").alias("za")), z.select(F.col("doc").alias("b"), F.col("z").alias("zb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "za", "zb").mapInArrow(_verify(size, percent), "a long, b long")
