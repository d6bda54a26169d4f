"""Quality rules: base counts of each text, and a calibrated logistic regression on hashed word and character n-grams.

Features are the shares of hashed words, word pairs and runs of three characters in a text, WIDTH of each kind, scaled
by their spread over the sample. The regression is fitted on a sample of labelled documents that is bounded in rows
(SAMPLE) and in features (ENTRIES, of whole documents in the order of the sample); held-back rows of it set the two numbers that turn its output into a probability (Platt). Texts are scored in Arrow batches; a text is
kept if the base rules pass and the probability is at least THRESHOLD.

Edge cases: null or empty text has no words and fails the base rules; repeated rows get equal results; null doc_ids
are scored too; with no labels of both kinds the regression is a constant; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import cut
from veilstream.llm.labelled import labelled_sample

WIDTH = 1 << 15
SAMPLE = 4000
#: Distinct features of all documents of the sample together, at most.
ENTRIES = 4_000_000
#: Features that the regression works on at a time.
AT_ONCE = 1 << 18
THRESHOLD = 0.3
#: Base rules: fewest words, most words in repeated windows in percent, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_U = np.uint64
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts[:-1], dtype=np.int64) if len(starts) > 1 else np.zeros(0, np.int64)


def base_counts(texts: list[bytes]) -> tuple[Counts, np.ndarray, np.ndarray]:
    """Counts of each text; with the words' texts and hashes, for the features."""
    n = len(texts)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    doc, h, start, end = H.words(texts)
    word_chars = _sums(((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13)), bounds)
    symbols = _sums(_SYMBOL[data], bounds)
    # words in windows that occur again
    m = max(0, len(h) - WINDOW + 1)
    window = doc[:m].astype(_U) * H.STEPS[7] + H.STEPS[6]
    for k in range(WINDOW):
        window = H.mix(window + h[k : k + m] * H.STEPS[k % 6])
    inside = doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m]
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order][1:] == window[order][:-1]
    again = np.union1d(order[1:][same], order[:-1][same])
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    # lines with a word that equal an earlier line
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate(([0], breaks[:-1] + 1))
    has_word = np.searchsorted(start, breaks) > np.searchsorted(start, first)
    line = H.hashes(data, first[has_word], breaks[has_word], H.BASES[1])
    owner = (np.searchsorted(bounds, first, "right") - 1)[has_word]
    _, once = np.unique(line + owner.astype(_U) * H.STEPS[3], return_index=True)
    dup = np.bincount(owner, minlength=n) - np.bincount(owner[once], minlength=n)
    return Counts(np.bincount(doc, minlength=n), word_chars, symbols, dup, repeated), doc, h


def grams(doc: np.ndarray, h: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index and feature of each word, word pair and run of three characters; the kinds one after another."""
    yield doc, (h % _U(WIDTH)).astype(np.int64)
    pair = doc[1:] == doc[:-1]
    yield doc[1:][pair], WIDTH + (H.mix(h[:-1] + h[1:] * H.STEPS[0])[pair] % _U(WIDTH)).astype(np.int64)
    signs = [np.frombuffer(t.decode().encode("utf-32-le"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [max(0, len(x) - 2) for x in signs])
    each = [(x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:]) * np.uint32(2654435761) >> np.uint32(17) for x in signs if len(x) > 2]
    yield owner, 2 * WIDTH + (np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64))


def shares(parts, n: int, weight: np.ndarray) -> np.ndarray:
    """For each text the sum over kinds of the mean weight of its features of that kind."""
    out = np.zeros(n)
    for doc, feature in parts:
        count = np.bincount(doc, minlength=n)
        out += np.bincount(doc, weights=weight[feature], minlength=n) / np.maximum(count, 1)
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * (raw + self.bias) + self.b, -30, 30)))


def fit(ends: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, rounds: int = 150) -> Model:
    """Logistic regression on sparse rows (where each ends, features, shares), four fifths of them; the rest calibrate it.

    Rows are worked on a few at a time, so there are no copies of the whole sample.
    """
    n, d = len(y), 3 * WIDTH
    share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    if len(np.unique(y)) < 2:
        return Model(np.zeros(d), float(np.log(share / (1 - share))))
    bounds = np.concatenate(([0], ends))
    cuts = [0]
    for i in range(1, n + 1):
        if i == n or bounds[i + 1] - bounds[cuts[-1]] > AT_ONCE:
            cuts.append(i)
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds[a : b + 1]))
        parts.append((a, b, at, features[bounds[a] : bounds[b]], values[bounds[a] : bounds[b]]))
    mean = sum(np.bincount(f, weights=v, minlength=d) for *_, f, v in parts) / n
    square = sum(np.bincount(f, weights=v * v, minlength=d) for *_, f, v in parts) / n
    scale = 1 / np.sqrt(np.maximum(square - mean * mean, 0) + 1e-6)
    held = np.random.default_rng(0).permutation(n) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    w, bias, m, s = np.zeros(d), 0.0, np.zeros(d + 1), np.zeros(d + 1)
    total = (~held).sum()

    def raw(weight: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, weights=v * weight[f], minlength=b - a) for a, b, at, f, v in parts])

    for t in range(1, rounds + 1):
        z = raw(w * scale) + bias
        g = np.where(held, 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        slope = sum(np.bincount(f, weights=v * g[a:b][at], minlength=d) for a, b, at, f, v in parts)
        grad = np.append(slope * scale + 1e-3 * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        step = 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    model = Model(w * scale, bias)
    if held.any():
        z = raw(model.weight)[held] + bias
        best = None
        for a in np.geomspace(0.1, 4, 30):
            for b in np.linspace(-2, 2, 21):
                q = np.clip(a * z + b, -30, 30)
                loss = float(np.mean(np.logaddexp(0, q) - y[held] * q))
                if best is None or loss < best[0]:
                    best = (loss, float(a), float(b))
        model.a, model.b = best[1:]
    return model


def _sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for lo, hi, texts in H.batches(part.column(0)):
            doc, h, _, _ = H.words(texts)
            found = [[] for _ in texts]
            for owner, feature in grams(doc, h, texts):
                count = np.bincount(owner, minlength=len(texts))
                key, times = np.unique(owner * (3 * WIDTH) + feature, return_counts=True)
                ends = np.searchsorted(key, np.arange(1, len(texts)) * (3 * WIDTH))
                for k, (one, c) in enumerate(zip(np.split(key % (3 * WIDTH), ends), np.split(times, ends), strict=True)):
                    found[k].append((one.astype(np.int32), (c / max(1, count[k])).astype(np.float32)))
            features = [np.concatenate([a for a, _ in x]).tobytes() for x in found]
            values = [np.concatenate([b for _, b in x]).tobytes() for x in found]
            n = pa.array([len(f) // 4 for f in features], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1)[lo:hi], part.column(2)[lo:hi], n, pa.array(features, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "n", "f", "v"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """At most `sample` rows with together at most `entries` features reach the driver."""
    rows = labelled_sample(docs, labels, sample).select("text", "doc_id", "y").mapInArrow(_sparse, "doc_id long, y int, n long, f binary, v binary")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    first = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over numbers of the sample's rows only
    chosen = rows.select("row", F.sum("n").over(first).alias("sum")).where(F.col("sum") <= entries)
    got = rows.join(F.broadcast(chosen), "row").sort("sum").select("y", "n", "f", "v").toArrow()
    features = np.frombuffer(b"".join(x.as_py() for x in got["f"]), np.int32)
    values = np.frombuffer(b"".join(x.as_py() for x in got["v"]), np.float32)
    return fit(np.cumsum(got["n"].to_numpy()), features, values, got["y"].to_numpy().astype(np.float64))


RULED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _judge(model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in parts:
            for lo, hi, texts in H.batches(part.column(1)):
                c, doc, h = base_counts(texts)
                p = m.probabilities(shares(grams(doc, h, texts), hi - lo, m.weight))
                numbers = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
                cols = [part.column(0)[lo:hi], *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(c.failed), pa.array(~c.failed & (p >= THRESHOLD)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RULED.split(", ")])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The base counts and verdicts of each row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_judge(model), RULED)
