import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from veilstream.llm import hashing as H
from veilstream.llm import near_dedup, shingle_join
from veilstream.llm.common import connecting
from veilstream.llm.quality_rules import base_counts
from veilstream.llm.repeats import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return Counter((a, len(sets[i]), None if a is None else least[find(i)]) for i, (a, _) in enumerate(rows))


def held(df, rows, **how):
    got = shingle_join.shingle_groups(df, **how).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, **how)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_odd(odd, odd_rows):
    held(odd, odd_rows)


def test_empty(empty):
    assert shingle_join.shingle_groups(empty).count() == 0


@pytest.mark.parametrize("sample", [64, 1])
def test_corpus(docs, monkeypatch, sample):
    """The same links whichever shingles are held to be frequent."""
    monkeypatch.setattr(shingle_join, "SAMPLE", sample)
    held(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("leaf", "box"), [(512, 16), (7, 2)])
def test_chains(spark, monkeypatch, leaf, box):
    """Chains of edited copies about the threshold, groups that share a passage, and many texts of one passage; also with tiny leaves."""
    monkeypatch.setattr(shingle_join, "LEAF", leaf)
    monkeypatch.setattr(shingle_join, "BOX", box)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows, word = [], iter(range(10**6))
    for g in range(14):
        words = ([*passage] if g % 2 else []) + [f"v{rng.randrange(3000)}" for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 15)):
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"n{next(word)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join([*passage, f"e{k % 9}", *(["tail"] * (k % 5))])) for k in range(60)]
    held(table(spark, rows), rows)


@pytest.mark.parametrize(("size", "percent"), [(1, 50), (3, 70), (5, 75)])
def test_other_parameters(spark, size, percent):
    rng = random.Random(size)
    rows = []
    for _ in range(60):
        words = prose(rng, 20, 60).split()
        for _ in range(3):
            words[rng.randrange(20)] = f"n{rng.randrange(40)}"
            rows.append((len(rows), " ".join(words)))
    held(table(spark, rows), rows, size=size, percent=percent)


def test_points_under_a_bound(spark):
    """Two sets never share more than the sum of the smaller counts, and boxes bound their points."""
    rng = np.random.default_rng(3)
    a, b = rng.poisson(3, (50, shingle_join.GROUPS)), rng.poisson(3, (50, shingle_join.GROUPS))
    n = a.sum(1)
    pairs = {(i, j) for i in range(50) for j in range(i) if 185 * np.minimum(a[i], a[j]).sum() >= 85 * (n[i] + n[j])}
    same = np.zeros((100, shingle_join.FINE // 64), "<u8")  # equal parities: only the counts decide
    x, y, _ = shingle_join._unit(a.astype("<u4"), same[:50], n, np.arange(50), np.zeros(50, int), 85)
    assert {(max(i, j), min(i, j)) for i, j in zip(x.tolist(), y.tolist(), strict=True)} == pairs
    side = np.repeat([0, 1], 50)
    both = np.concatenate((a, b)).astype("<u4")
    n = both.sum(1)
    x, y, similar = shingle_join._unit(both, same, n, np.arange(100), side, 30)
    want = {(i, j) for i in range(50) for j in range(50, 100) if 130 * np.minimum(both[i], both[j]).sum() >= 30 * (n[i] + n[j])}
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == want
    on = connecting(x, y, similar, np.arange(100) // 10)
    assert on.sum() <= 9
    assert similar[on].max() == similar.max()


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_made_to_collide(spark, n):
    """Words whose polynomial hashes modulo 2**64 are equal, in all operators that hash words, lines and substrings."""
    one, two = thue_morse(n)
    rows = [(1, one), (2, two), (3, f"{one}\n{two}\n{one}"), (4, " ".join([one, *"abcdefg", two, *"abcdefg"]))]
    held(table(spark, rows), rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i for i in range(1, 5)}
    assert near_dedup.deduplicated(table(spark, rows)).count() == 4
    counts, _, _ = base_counts([f"{one}\n{two}".encode(), f"{one}\n{two}\n{one}".encode(), rows[3][1].encode()])
    assert counts.n_dup_lines.tolist() == [0, 1, 0]
    assert counts.n_repeat_words.tolist() == [0, 0, 0]
    pair = [(1, one + "x" * 401), (2, two + "y" * 401)]
    covered = 0
    for i, (_, t) in enumerate(pair):
        others = [pair[1 - i][1], t]
        on = np.zeros(len(t), bool)
        for at in range(len(t) - 399):
            sub = t[at : at + 400]
            if sub in others[0] or t.find(sub) != at or t.find(sub, at + 1) != -1:
                on[at : at + 400] = True
        covered += int(on.sum())
    assert sum(r.n_removed for r in remove_repeats(table(spark, pair)).collect()) == covered


def test_exact_shingles():
    texts = ["a b c d e", "A B", "", "b c d e f", "a b c d e", "a  b\nc d"]
    for size in (1, 3, 4, 5):
        got = H.exact_shingles([t.lower().encode() for t in texts], size)
        want = [shingles(t, size) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in want]
        for i in range(len(texts)):
            assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for j in range(i))


def test_parities_of_large_sets(spark):
    """Sets differ in at least as many shingles as their parities differ in groups, whatever the numbers of groups."""
    rng = np.random.default_rng(4)
    for n, other in ((3000, 3000), (3000, 9000), (1500, 40)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: n - other // 4], rng.integers(0, 2**63, other).astype(np.uint64)))
        x, y = (shingle_join._parities(H.mix(z), 1 << int(2 * len(z) - 1).bit_length()) for z in (a, b))
        unlike = len(np.setxor1d(a, b))
        assert min(0.5 * unlike, 3000) <= shingle_join._apart(x, y) <= unlike
    words = [f"v{k}" for k in range(4000)]
    rows = []
    for i, edits in enumerate((0, 30, 150, 170, 700)):
        w = list(words)
        for k in range(edits):
            w[k * 4000 // max(edits, 1)] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    held(table(spark, rows), rows)
