import random
import re
import zlib
from collections import Counter, defaultdict

from veilstream.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(odd, odd_rows):
    rows = sharding.shard(odd, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_stay_together_and_bytes_are_near(docs):
    rows = sharding.shard(docs, 4).join(docs, "doc_id").collect()
    shards, sizes = defaultdict(set), Counter()
    for r in rows:
        shards[r.text].add(r.shard)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 4


def test_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AT_A_TIME", 8)
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * rng.randint(1, 999) + str(i)) for i in range(900)], "doc_id long, text string")
    sizes = Counter()
    rows = sharding.shard(df, 5).collect()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 900 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 5


def test_difference_is_tight():
    rng = random.Random(2)
    items = [rng.randint(1, 10**6) for _ in range(400)]
    got = sharding.difference([[x, 0, 0, 0] for x in items], 4)
    sums = Counter()
    for x, g in zip(items, got, strict=True):
        sums[g[0]] += x
    assert max(sums.values()) - min(sums.values()) < 100


def wanted(sizes):
    """Targets by sharing anew until none is above three times its source's size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def check_mix(df, rows):
    got = mixing.mix(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target, taken = wanted(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first)
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix(df.repartition(5)).collect()]
    return got


def test_mix_odd(odd, odd_rows):
    check_mix(odd, [(r.doc_id, r.text, r.source) for r in odd.collect()])


def test_mix_with_limits(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), s) for i in range(300) for s in [rng.choice(["a", "b", "b", "b", "b", "c", "c", "d", None])]]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


def test_mixed_rows(odd, empty):
    for miss in (0.0, mixing.MISS, 1.0):
        out = mixing.mixed(odd, miss)
        assert out.columns == odd.columns
        words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
        plan = mixing.mix(odd, miss).collect()
        assert words == sum(r.taken for r in plan)
        if miss:  # within the share, and whole where that is so
            for s in {r.source for r in plan}:
                rows = [r for r in plan if r.source == s and r.size]
                taken = sum(r.taken for r in rows)
                cut = [r for r in rows if r.taken % r.size]
                assert (not cut and abs(taken - rows[0].target) <= miss * rows[0].target + 1) or (len(cut) == 1 and abs(taken - rows[0].target) <= 1)
    assert mixing.mixed(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mixed_takes_every_row_as_its_own(spark):
    """One text in two sources, one id with two texts, rows that are repeated, clashing columns."""
    rows = [(1, "a b c d", "x", 0), (1, "a b c d", "y", 1), (1, "e f g", "x", 2), (1, "e f g", "x", 3), (None, "h i", None, 4), (2, "", "y", 5)]
    rows += [(i, "w " * (i % 9), "xy"[i % 2], i) for i in range(10, 60)]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], "doc_id long, text string, source string, nr int, row string, at string, words string, _d string")
    plan = mixing.mix(df).collect()
    want = Counter()
    for r in plan:
        want[r.source] += r.taken
    got, seen = Counter(), Counter()
    texts = {r[3]: (r[1], r[2]) for r in rows}
    for r in mixing.mixed(df, 0.0).collect():
        got[r.source] += len(WORD.findall(r.text))
        seen[r.nr] += 1
        assert texts[r.nr][1] == r.source and texts[r.nr][0].startswith(r.text) and (r.row, r.at, r.words, r["_d"]) == ("c",) * 4
    assert +got == +want and max(seen.values()) <= 3
    assert {0, 1} & set(seen) and all(s in got for s in ("x", "y", None))


def test_position_inverts_demand(spark):
    rows = spark.range(101).selectExpr("id / 100 AS share", "0.5D AS slope").union(spark.range(101).selectExpr("id / 100", "-0.5D"))
    for r in rows.withColumn("t", mixing.position(mixing.F.col("share"), mixing.F.col("slope"))).collect():
        assert abs(r.t + r.slope * (r.t * r.t - r.t) - r.share) < 1e-9
