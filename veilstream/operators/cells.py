"""Vector top-k over a table in cells around sampled centres: cells that cannot hold one of the best are not read.

Angles between vectors keep the triangle inequality. A row whose angle to its cell's centre is a stands at an angle of at
least |f - a| to a query whose angle to the centre is f, so a cell is out for a query where that exceeds the angle of the
k-th best row that is known already. Results are exact whatever the sample was; it decides only how much is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.operators.chunks import products, unit
from veilstream.sources.tables import shared_folder

#: Angles are compared, and scores of one row met in two products, with this much to spare.
SPARE = 1e-6


class Cells(NamedTuple):
    """A table (chunk_id, vector, cell) in folders by cell; of each cell its centre, its least and largest angle, and its rows.

    The last cell holds vectors without length, which are like nothing (0) and never left out.
    """

    path: str
    kinds: dict[str, str]
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n unit vectors around which the sample lies."""
    sample = sample[np.abs(sample).sum(axis=1) > 0]
    if not len(sample):
        return sample
    sample = np.unique(sample, axis=0)
    found = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), found)
    return found


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


def vector_cells(chunks: DataFrame, centres: int = 64, sample: int = 4096) -> Cells:
    """chunks (chunk_id, vector) written to the shared folder in at most `centres` cells. At most `sample` rows, chosen by a hash, come to the driver.

    Rows without a vector are left out. Cells of many rows are written by several tasks.
    """
    spark, path = chunks.sparkSession, f"{shared_folder(chunks.sparkSession)}/cells-{uuid.uuid4().hex}"
    rows = chunks.where("vector is not null").select("chunk_id", "vector")
    drawn = rows.orderBy(F.xxhash64("chunk_id", "vector")).limit(sample).select("vector").toArrow()["vector"]
    sent = _centres(unit(drawn), centres)
    kinds = dict(rows.dtypes)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = unit(part.column(1))
            some = np.abs(v).sum(axis=1) > 0
            angle, cell = np.zeros(len(v)), np.full(len(v), len(sent), np.int32)
            if len(sent) and some.any():
                near = _angles(v[some], sent)
                cell[some] = near.argmin(axis=1)
                angle[some] = near.min(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(angle), pa.array(cell)], names=["chunk_id", "vector", "angle", "cell"])

    placed = rows.mapInArrow(place, f"chunk_id {kinds['chunk_id']}, vector {kinds['vector']}, angle double, cell int")
    placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(path)
    low, high, count = np.full(len(sent) + 1, np.inf), np.full(len(sent) + 1, -np.inf), np.zeros(len(sent) + 1, np.int64)
    for r in _stored(spark, path, kinds).groupBy("cell").agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        low[r["cell"]], high[r["cell"]], count[r["cell"]] = r["a"], r["b"], r["n"]
    return Cells(path, kinds, sent, low, high, count)


def _stored(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    return spark.read.schema(f"chunk_id {kinds['chunk_id']}, vector {kinds['vector']}, angle double, cell int").parquet(path)


def _best(rows: DataFrame, ids: pa.Array, asked: np.ndarray, needed: np.ndarray, least: np.ndarray, k: int, shape: str) -> DataFrame:
    """What may be among the k best of rows (chunk_id, vector, cell), for the queries that need its cell (a table of queries x cells)."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, asked, needed, least))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, needed, least = sent.value
        least = least.copy()
        for part in parts:
            cells = part.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                some = np.flatnonzero(needed[:, cell])
                at = np.flatnonzero(cells == cell)
                for lo in range(0, len(at) if len(some) else 0, 1000):
                    own = part.take(pa.array(at[lo : lo + 1000]))
                    v = unit(own.column(1))
                    like = q[some] @ v.T
                    if own.num_rows >= k:
                        least[some] = np.maximum(least[some], np.partition(like, own.num_rows - k, axis=1)[:, own.num_rows - k] - SPARE)
                    row, col = np.nonzero(like >= least[some][:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[row])), own.column(0).take(pa.array(col)), pa.array(products(q, v, some[row], col))], names=["query_id", "chunk_id", "similarity"])

    return rows.select("chunk_id", "vector", "cell").mapInArrow(run, shape)


def _blocks(home: np.ndarray, block: int) -> list[np.ndarray]:
    """Queries in blocks of at most `block`, neighbours together."""
    order = np.argsort(home, kind="stable")
    return [order[lo : lo + block] for lo in range(0, len(order), block)]


def top_by_cells(queries: DataFrame, cells: Cells, k: int = 3, block: int = 4096) -> tuple[DataFrame, float]:
    """(query_id, chunk_id, similarity, rank) of the k chunks most like each query, best first, ties by chunk_id; and the share of products left out.

    queries (query_id, vector) are a stated set whose ids and vectors pass through the driver, worked on in blocks of near
    ones. A block's queries first meet the cells in which they lie; the k-th best found there rules out other cells, and
    only what is left is read. Queries without a vector are left out.
    """
    spark = queries.sparkSession
    shape = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {cells.kinds['chunk_id']}, similarity double"
    stored = _stored(spark, cells.path, cells.kinds)
    got = queries.where("vector is not null").select("query_id", "vector").toArrow()
    ids, asked = got["query_id"].combine_chunks(), unit(got["vector"])
    n, zero = len(cells.rows), len(cells.centres)
    angles = np.hstack([_angles(asked, cells.centres), np.zeros((len(asked), 1))]) if len(asked) and zero else np.zeros((len(asked), n))
    there = cells.rows > 0
    home = np.where(there[:zero], angles[:, :zero], np.inf).argmin(axis=1) if zero and len(asked) else np.zeros(len(asked), int)
    parts, left = [spark.createDataFrame([], shape)], 0
    for at in _blocks(home, block):
        first = np.zeros((len(at), n), bool)
        first[:, zero] = there[zero]
        first[np.arange(len(at)), home[at]] = True
        own = [int(c) for c in np.flatnonzero(first.any(axis=0) & there)]
        near = _best(stored.where(F.col("cell").isin(own)), ids.take(pa.array(at)), asked[at], first, np.full(len(at), -np.inf), k, shape)
        parts.append(near)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
        kth = {r[0]: r[1] for r in near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", "similarity").collect()}
        least = np.array([kth.get(i, -np.inf) for i in ids.take(pa.array(at)).to_pylist()]) - SPARE
        gap = np.maximum(0, np.maximum(angles[at] - cells.high, cells.low - angles[at]) - SPARE)
        needed = (np.cos(np.where(np.isfinite(gap), gap, 0)) >= least[:, None]) & there & ~first
        left += int(((~needed & ~first & there) * cells.rows).sum())
        rest = [int(c) for c in np.flatnonzero(needed.any(axis=0))]
        if rest:
            parts.append(_best(stored.where(F.col("cell").isin(rest)), ids.take(pa.array(at)), asked[at], needed, least, k, shape))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    share = left / max(1, len(asked) * int(cells.rows.sum()))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), share
