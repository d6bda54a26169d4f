import random
import re
from collections import Counter

import numpy as np
import pytest

from veilstream.llm import near_dedup
from veilstream.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            linked = sets[i] and 100 * both >= 75 * len(sets[i] | sets[j])
            if a is not None and b is not None and linked:
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return Counter((a, len(sets[i]), None if a is None else least[find(i)]) for i, (a, _) in enumerate(rows))


def held(df, rows):
    got = near_dedup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_odd(odd, odd_rows):
    held(odd, odd_rows)


def test_corpus(docs):
    held(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bucket", [3000, 12])
def test_chains_of_copies(spark, monkeypatch, bucket):
    """Copies of copies, linked only to their neighbours, and groups just under the threshold; also with tiny buckets."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    rng = random.Random(8)
    rows, word = [], iter(range(10**6))
    for _ in range(12):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 15)):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{next(word)}"
            rows.append((len(rows), " ".join(words)))
    held(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


@pytest.mark.parametrize("bucket", [3000, 7])
def test_buckets_over_the_limit(spark, monkeypatch, bucket):
    """Pairs that share no band but that of their bucket are compared, whatever its size; pairs of one group are not."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    rng = random.Random(10)
    rows = []
    for _ in range(12):
        words = [f"v{rng.randrange(9000)}" for _ in range(80)]
        rows += [(len(rows) + k, " ".join([*words, f"n{len(rows) + k}"])) for k in range(3)]
    for _ in range(20):
        rows.append((len(rows), " ".join([*words, f"n{len(rows)}"])))
    group = {d: 1000 if d >= 36 else d for d, _ in rows}
    signed = spark.createDataFrame([(d, d, t) for d, t in rows], "doc_id long, tag long, text string").mapInArrow(near_dedup._sign(5, 1, 4), near_dedup.SIGNED).withColumnRenamed("doc_id", "doc")
    open_ = spark.createDataFrame([(1, d, g, len(rows)) for d, g in group.items()], "key long, doc long, grp long, n long")
    got = {(r.a, r.b) for r in near_dedup._cross(open_, signed, 75).collect()}
    kin = lambda d: min(d // 3, 11)
    assert got == {(a, b) for a in group for b in group if a < b and kin(a) == kin(b) and group[a] != group[b]}


def test_one_id_with_several_texts(spark):
    rng = random.Random(11)
    words = [f"v{rng.randrange(3000)}" for _ in range(100)]
    near = [*words[:40], "changed", *words[41:]]
    rows = [(1, "short text of its own here"), (1, " ".join(words)), (2, " ".join(near)), (2, "and another one that stands alone"), (1, "short text of its own here"), (3, ""), (3, "")]
    held(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def brute_deduplicated(rows):
    """Of each group the row of the smallest doc_id stays, and rows equal in id and text once."""
    rows = sorted(set(rows), key=str)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [(min(d for d, _ in g), {t for d, t in g if d == min(d for d, _ in g)}) for g in groups.values()]


def test_deduplicated_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (2, "o p q r s t u"), (3, "a b c d e f g"), (4, ""), (5, ""), (6, None)]
    for k in range(40):
        words = [f"v{rng.randrange(500)}" for _ in range(60)]
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(60)] = "x"
            rows.append((rng.randrange(7, 60), " ".join(words)))
    names = ["kept_id", "kept_tag", "tag", "n", "m", "component", "_d", "row"]
    df = spark.createDataFrame([(*r, *[k] * len(names)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    want = brute_deduplicated(rows)
    assert len(left) == len(want)
    for d, texts in want:
        hit = next(r for r in left if r[0] == d and r[1] in texts)
        left.remove(hit)
    assert not left


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).collect() == []
    assert near_dedup.deduplicated(empty).collect() == []


def test_deduplicated(odd):
    out = near_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 0 and kept[None] == 2 and kept[4] == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    doc = np.repeat([0, 1], 350)
    sig = near_dedup.signatures(doc, np.concatenate((both, a, both, b)), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.15
    one = near_dedup.signatures(np.zeros(1, np.int64), np.array([5], np.uint64), 1)
    assert len(set((one >> np.uint64(56)).ravel().tolist())) == near_dedup.SLOTS  # one shingle gives every slot another rank


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got}
    assert {x for a, b in edges if a != b for x in (a, b)} == set(got)
