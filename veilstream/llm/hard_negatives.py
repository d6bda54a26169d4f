"""Hard negatives of anchor vectors by blocked matrix products.

Anchors are cut into waves of bounded size, and a wave goes to all tasks. In a task every block of anchors is multiplied
with every block of candidates in float64, which is exact as long as no sum reaches 2**53; rows whose components are too
large for that are multiplied in whole numbers of any size, and scores beyond 64 bits stop at their limits.

First pass: each task keeps the best positives of every anchor, and the tasks' lists are merged. Second pass: the same
for negatives, whose scores must lie in the window that each positive opens. Tasks hand on at most so many rows
for an anchor (and positive) as are returned, so a label or vector that holds most of the rows makes no difference.

Edge cases: rows with a null label, a null vector or a component that is null or not finite take no part; shorter
vectors count as filled up with zeros; a row with a null vec_id may be found, last among ties, but is no anchor. Equal
rows count each for itself, but rows of an anchor's own vec_id are never its positives. No anchors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.common import cut, numbered

#: Anchors of a wave, as rows and as bytes; rows of a block of anchors and of candidates.
WAVE, WAVE_BYTES, BLOCK = 16384, 1 << 25, 1024
#: Found rows that are held before they are merged.
HELD = 1 << 20
_LIMIT = 2**63 - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Wave:
    """Anchors with their windows: a row of low and high for each positive, none in the first pass."""

    no: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def matrix(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """The vectors as rows of whole numbers, filled up with zeros to the longest and to width."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as int64."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    x, y = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    fine_a = x * max(float(y.max(initial=0)), 1.0) * max(width, 1) < 2.0**53
    fine_b = y * max(float(x[fine_a].max(initial=0)), 1.0) * max(width, 1) < 2.0**53
    if fine_a.all() and fine_b.all():
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(fine_a, fine_b)] = (a[fine_a] @ b[fine_b].T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    for rows, cols in ((~fine_a, np.ones(len(b), bool)), (fine_a, ~fine_b)):
        if rows.any() and cols.any():
            out[np.ix_(rows, cols)] = np.clip(whole(a[rows]) @ whole(b[cols]).T, -_LIMIT, _LIMIT).astype(np.int64)
    return out


class Best:
    """The best `most` rows of each owner: higher scores first, then smaller ids, those without an id last."""

    def __init__(self, owners: int, most: int):
        self.most, self.floor = most, np.full(owners, -_LIMIT - 1)
        self.parts, self.held = [], 0

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        self.parts.append((owner, score, ids, nameless))
        self.held += len(owner)
        if self.held > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        owner, score, ids, nameless = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, nameless, -score, owner))
        owner = owner[order]
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        last = order[place == self.most - 1]
        self.floor[owner[place == self.most - 1]] = score[last]
        keep = order[place < self.most]
        owner = owner[place < self.most]
        self.parts, self.held = [(owner, score[keep], ids[keep], nameless[keep])], 0
        return self.parts[0]


def _scan(wave: Wave, most: int, scale: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = 1 if wave.low is None else wave.low.shape[1]
        best = Best(len(wave.no) * windows, most)
        for part in parts:
            for lo in range(0, part.num_rows, BLOCK):
                p = part.slice(lo, BLOCK)
                vec = matrix(p.column(2), scale, wave.vec.shape[1])
                nameless = p.column(0).is_null().to_numpy(zero_copy_only=False)
                ids, label = p.column(0).fill_null(0).to_numpy(), p.column(1).to_numpy()
                for i in range(0, len(wave.no), BLOCK):
                    on = slice(i, i + BLOCK)
                    score = products(wave.vec[on], vec)
                    same = wave.label[on, None] == label
                    if wave.low is None:
                        fine = same & ((wave.ids[on, None] != ids) | nameless) & (score >= best.floor[on, None])
                        a, c = np.nonzero(fine)
                        best.add(i + a, score[a, c], ids[c], nameless[c])
                        continue
                    for k in range(windows):
                        owner = (np.arange(i, min(i + BLOCK, len(wave.no)))) * windows + k
                        fine = ~same & (score >= np.maximum(wave.low[on, k], best.floor[owner])[:, None]) & (score <= wave.high[on, k][:, None])
                        a, c = np.nonzero(fine)
                        best.add(owner[a], score[a, c], ids[c], nameless[c])
            best.merge()
        owner, score, ids, nameless = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(wave.no[owner // windows]), pa.array((owner % windows).astype(np.int32)), pa.array(score), pa.array(ids, mask=nameless)], names=["no", "window", "score", "id"])

    return run


FOUND = "no long, window int, score long, id long"


def _first(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' lists, with their place from 1."""
    order = Window.partitionBy("no", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest s with low * score <= 100 * s <= high * score."""
    return max(-_LIMIT, -((-low * score) // 100)), min(_LIMIT, (high * score) // 100)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor (vec_id divisible by `every`) and positive its hard negatives; vectors: vec_id, label, embedding.

    Scores are inner products of floor(scale * component); a negative has another label and between low and high
    percent of the positive's score.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    anchors = cut(numbered(rows.where(F.col("vec_id") % every == 0), [], [F.col("vec_id"), F.xxhash64("label", "vec")], "no", 64))
    about = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    wave_rows = max(1, min(WAVE, WAVE_BYTES // (8 * max(about["width"] or 1, 1))))
    out = spark.createDataFrame([], RESULT)
    for at in range(0, about["n"], wave_rows):
        held = anchors.where(F.col("no").between(at, at + wave_rows - 1)).orderBy("no").toArrow().combine_chunks()  # at most a wave
        wave = Wave(held["no"].to_numpy(), held["vec_id"].to_numpy(), held["label"].to_numpy(), matrix(held["vec"].combine_chunks(), scale))
        near = cut(_first(rows.mapInArrow(_scan(wave, positives, scale), FOUND), positives).select("no", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        shape = (len(wave.no), positives)
        wave.low, wave.high = np.full(shape, _LIMIT), np.full(shape, -_LIMIT)
        for r in near.toLocalIterator():  # at most `positives` for each anchor of the wave
            wave.low[r["no"] - at, r["window"]], wave.high[r["no"] - at, r["window"]] = _window(r["positive_score"], low, high)
        far = _first(rows.mapInArrow(_scan(wave, negatives, scale), FOUND), negatives)
        named = near.join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
        found = far.select("no", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["no", "window"])
        out = out.union(cut(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    return out
