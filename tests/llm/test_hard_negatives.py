import math
import random

import numpy as np
import pytest

from veilstream.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<double>, label int, score string, no string, window string"


def brute(rows, every=100):
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for i, v, y in fine:
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, z) for j, w, z in fine]
        for s, j, _ in sorted((p for p in scored if p[2] == y and p[1] != i), key=key)[:5]:
            far = sorted((p for p in scored if p[2] != y and 30 * s <= 100 * p[0] <= 90 * s), key=key)[:10]
            out += [(i, j, r + 1, p[1], s, p[0]) for r, p in enumerate(far)]
    return sorted(out, key=str)


def held(spark, rows, every=100):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SHAPE).repartition(3)
    got = hn.hard_negatives(df, every).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, every)
    return got


def some(rng, n, dim=8, labels=3):
    return [(i, [rng.gauss(0.3, 1) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("wave", "block", "held_rows"), [(16384, 1024, 1 << 20), (2, 16, 10)])
def test_whole_tables(spark, monkeypatch, wave, block, held_rows):
    """The same rows with one wave and with several, with large and with tiny blocks."""
    monkeypatch.setattr(hn, "WAVE", wave)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "HELD", held_rows)
    rng = random.Random(1)
    assert len(held(spark, some(rng, 300), every=50)) > 100


def test_odd_rows(spark):
    """Nulls, values that are not finite, short and empty vectors, ties, equal rows, negative and missing ids."""
    rng = random.Random(2)
    rows = some(rng, 120, 4)
    rows += [(400, None, 1), (500, [1.0, None, 1.0, 1.0], 1), (600, [1.0, float("nan"), 0.0, 0.0], 1), (700, [float("inf")] * 4, 1), (800, [1.0] * 4, None)]
    rows += [(900, [1.0, 2.0], 1), (1000, [], 1), (-100, [1.0, 1.0, 1.0, 1.0], 1), (None, [1.5, 1.0, 1.0, 1.0], 1), (None, [0.6, 0.5, 0.5, 0.5], 2)]
    rows += [(1001 + k, [0.5, 0.5, 0.5, 0.5], k % 3) for k in range(30)] + [(1001, [0.5, 0.5, 0.5, 0.5], 0)] * 2
    held(spark, rows)


def test_large_components(spark):
    """Products beyond 2**53 are exact."""
    rows = [(0, [3e6, 1.0], 0), (1, [3e6, 1.003], 0), (2, [2e6, 1.007], 1), (3, [2e6, 1.011], 1), (4, [1.0, 1.0], 0), (100, [2.0, 3.0], 1), (5, [1.0, 2.0], 1)]
    held(spark, rows)
    a, b = np.array([[1e30, 1.0]]), np.array([[1e30, 2.0], [-1e30, 0.0], [1.0, 5.0]])
    assert hn.products(a, b).tolist() == [[2**63 - 1, 1 - 2**63, min(2**63 - 1, int(1e30) + 5)]]


def test_none(spark):
    assert hn.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_windows():
    for s in range(-250, 250, 7):
        lo, hi = hn._window(s, 30, 90)
        assert [x for x in range(-400, 400) if 30 * s <= 100 * x <= 90 * s] == list(range(lo, hi + 1))
