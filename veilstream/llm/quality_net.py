"""Quality classifier: random-indexing vectors, pooled per document, and a small network.

Units are runs of letters, digits or symbols; a run's shape (its kinds of characters) and whether it repeats one of
the two runs before it are units too. Each hashed unit has a sparse random index vector; a run's context vector is the
sum of the index vectors of the runs near it, over all documents. A document is the mean and the deviation of its units' vectors. A network of two layers is fitted on a
bounded sample of labelled documents, and its logits are divided by a temperature fitted on held-back rows of it.

The table of vectors has UNITS x DIM numbers however large the corpus is; a task sends no more than that, and Spark adds
up whole numbers, so the sums do not depend on the order of tasks.
Edge cases: null or empty text has no units, is the zero vector and gets that vector's score; repeated rows get equal
scores; null doc_ids are scored too (held_out null); with no labels of both kinds every score is the share of label 1,
or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.labelled import labelled_sample

UNITS, DIM, SPARSE, REACH = 1 << 14, 32, 4, 2
#: Units from here on are shapes, the last four tell of repeats.
SHAPES, REPEATS = UNITS - 1024, UNITS - 4
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 6000
THRESHOLD = 0.3
#: Bytes of text that contexts are counted of at a time.
AT_ONCE = 1 << 19

_U = np.uint64
#: Kinds of bytes: 0 white space, 1 lower-case letter, 2 capital, 3 digit, 4 other letter (beyond ASCII), 5 and up: a symbol each.
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 5 + np.arange(128)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
#: Of each kind: what runs are made of (letters, digits, symbols), and its bit in a shape.
_RUN = np.array([0, 1, 1, 3, 1] + [5] * 128, np.int8)
_BITS = np.array([1 << k for k in range(5)] + [1 << (5 + k % 32) for k in range(128)], np.int64)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each run its text's index and its hashed units: itself, its shape, its repeats."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    run = _RUN[kind]
    edge = np.flatnonzero(np.diff(run, prepend=-1))
    on = np.flatnonzero(run[edge] > 0)
    start, end = edge[on], np.append(edge[1:], len(data))[on]
    word = H.hashes(data, start, end)
    bits = np.bitwise_or.reduceat(_BITS[kind], edge)[on]
    shape = H.mix(bits.astype(_U) * H.STEPS[0] + np.minimum(end - start, 12).astype(_U) // _U(3) * H.STEPS[1])
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(firsts, start, "right") - 1
    again = np.zeros(len(word), np.int64)
    for k in (1, 2):
        again[k:] += k * ((word[k:] == word[:-k]) & (doc[k:] == doc[:-k]))
    unit = np.stack(((word % _U(SHAPES)).astype(np.int64), SHAPES + (shape % _U(REPEATS - SHAPES)).astype(np.int64), REPEATS + again), 1)
    return doc, unit


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each unit's index vector."""
    h = H.mix(np.arange(UNITS * SPARSE, dtype=_U) + H.STEPS[2])
    return (h % _U(DIM)).astype(np.int64).reshape(UNITS, SPARSE), np.where((h >> _U(32)) & _U(1), 1.0, -1.0).reshape(UNITS, SPARSE)


def contexts(texts: list[bytes]) -> np.ndarray:
    doc, unit = units(texts)
    word = unit[:, 0]
    place, sign = index_vectors()
    flat, weight = [], []
    for step in range(1, REACH + 1):
        a, b = word[:-step], word[step:]
        on = doc[:-step] == doc[step:]
        for x, y in ((a[on], b[on]), (b[on], a[on])):
            flat.append((x[:, None] * DIM + place[y]).ravel())
            weight.append(sign[y].ravel())
    return np.bincount(np.concatenate(flat), weights=np.concatenate(weight), minlength=UNITS * DIM)


CONTEXTS = "unit int, " + ", ".join(f"c{i} long" for i in range(DIM))


def _gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one task: a row for each unit that occurs in it."""
    total, size, held = np.zeros(UNITS * DIM), 0, []
    for part in parts:
        for _, _, texts in H.batches(part.column(0), AT_ONCE):
            held += texts
            size += sum(map(len, texts))
            if size > AT_ONCE:
                total += contexts(held)
                size, held = 0, []
    if held:
        total += contexts(held)
    table = total.astype(np.int64).reshape(UNITS, DIM)
    on = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *[pa.array(table[on, i]) for i in range(DIM)]], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """UNITS x DIM context vectors of unit length, from all texts; at most UNITS rows of sums reach the driver."""
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_gather, CONTEXTS).groupBy("unit").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIM)])
    got = sums.toArrow()
    out = np.zeros((UNITS, DIM), np.float32)
    out[got["unit"].to_numpy()] = np.stack([got[f"c{i}"].to_numpy() for i in range(DIM)], axis=1)
    place, sign = index_vectors()
    own = np.zeros((UNITS, DIM), np.float32)
    np.add.at(own, (np.repeat(np.arange(UNITS), SPARSE), place.ravel()), sign.ravel())
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-6) + own / 2).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of each text's units."""
    doc, unit = units(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        both = np.concatenate((vectors, vectors * vectors), axis=1) if vectors.shape[1] == DIM else vectors
        total = np.add.reduceat(both[unit[:, 0]], np.concatenate(([0], np.cumsum(n[some])[:-1])), axis=0)
        few = UNITS - SHAPES  # shapes and repeats are few: count them and multiply
        seen = np.bincount((doc[:, None] * few + unit[:, 1:] - SHAPES).ravel(), minlength=len(texts) * few).reshape(-1, few)
        mean = (total + seen[some].astype(np.float32) @ both[SHAPES:]) / (3 * n[some, None])
        out[some, :DIM] = mean[:, :DIM]
        out[some, DIM:] = np.sqrt(np.maximum(mean[:, DIM:] - mean[:, :DIM] ** 2, 0))
    return out


def pooled_all(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """pooled() a few texts at a time."""
    both = np.concatenate((vectors, vectors * vectors), axis=1)
    parts = [pooled(texts[lo:hi], both) for lo, hi in H.slices(np.array([len(t) for t in texts], np.int64), 1 << 18)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM), np.float32)


@dataclass
class Net:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400, decay: float = 1e-3) -> Net:
    """Adam on the cross entropy of four fifths of the rows; the rest set the temperature."""
    d = x.shape[1]
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    blank = Net(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return blank
    rng = np.random.default_rng(0)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    xt, yt = (x[~held], y[~held]) if len(np.unique(y[~held])) == 2 else (x, y)
    net = Net(xt.mean(0), xt.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (xt - net.center) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * p[0] / 10, back.sum(0), h.T @ g + decay * p[2] / 10, np.array([g.sum()])]
        for k, q in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if held.any():
        raw = net.logits(x[held])

        def loss(temperature: float) -> float:
            q = np.clip(raw / temperature, -30, 30)
            return float(np.mean(np.logaddexp(0, q) - y[held] * q))

        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


def _pool(vectors):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, texts in H.batches(part.column(0)):
                yield pa.RecordBatch.from_arrays([part.column(1)[lo:hi], pa.array([r.tobytes() for r in pooled_all(texts, vectors.value)], pa.binary())], names=["y", "x"])

    return run


def _score(model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for part in parts:
            for lo, hi, texts in H.batches(part.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], pa.array(net.scores(pooled_all(texts, vectors)))], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Vectors and network as a broadcast variable. At most `sample` rows of pooled vectors reach the driver."""
    context = docs.sparkSession.sparkContext
    vectors = word_vectors(docs)
    rows = labelled_sample(docs, labels, sample, ~held_out()).select("text", "y").mapInArrow(_pool(context.broadcast(vectors)), "y int, x binary").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, 2 * DIM)
    y = np.array([r["y"] for r in rows], np.float64)
    order = np.lexsort((*x.T, y))  # the rows come in any order
    return context.broadcast((vectors, fit(x[order], y[order])))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; only labels of rows that are not held out are learned."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(train(docs, labels, sample)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all of their columns."""
    model = train(docs, labels, sample)
    place = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for part in parts:
            for lo, hi, texts in H.batches(part.column(place)):
                yield part.slice(lo, hi - lo).filter(pa.array(net.scores(pooled_all(texts, vectors)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
