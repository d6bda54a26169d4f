import math
import random
import re
from collections import Counter

import pytest

from tests.llm.conftest import prose
from veilstream.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    docs_n, total = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * docs_n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def held(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, row string, n string").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, no string").repartition(2)
    got = lexical.search(d, q, **how).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, how.get("k", 50))


def corpus(rng, n, words=300):
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randint(1, 120)))) for i in range(n)]


@pytest.mark.parametrize(("cells", "block", "candidates", "broadcast"), [(1 << 22, 1 << 18, 200, 1 << 17), (64, 12, 20, 0)])
def test_against_brute_force(spark, monkeypatch, cells, block, candidates, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST", broadcast)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "TERMS", block)
    monkeypatch.setattr(lexical, "CANDIDATES", candidates)
    rng = random.Random(4)
    docs = corpus(rng, 400)
    items = [(j, prose(rng, rng.randint(1, 8), 300)) for j in range(9)] + [(20, docs[7][1])]
    held(spark, docs, items, k=10)


def test_rounds_settle_items(spark):
    """A rare item is proven by the first tier, one of common words falls through; both are right."""
    rng = random.Random(6)
    docs = corpus(rng, 300, 40) + [(1000 + i, f"rare{i % 3} w1 w2") for i in range(9)]
    proofs = []
    items = [(1, "rare0"), (2, "w1 w2 w3 w4 w5 w6 w7 w8")]
    held(spark, docs, items, k=5, proofs=proofs)
    assert proofs[0] >= 1
    assert sum(proofs) == 2


def test_odd(spark, odd_rows):
    items = [(1, "one A-B 😀é"), (2, None), (3, " \n"), (None, "same w1 w2 w3"), (4, "same w1 w2 w3"), (4, "x ABCDEF0123456789 abcdef0123456789abcdef"), (5, "notthere"), (6, " ".join(f"w{i}" for i in range(500)))]
    held(spark, odd_rows, items)


def test_none(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(empty, items.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
