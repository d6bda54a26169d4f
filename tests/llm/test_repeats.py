import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from veilstream.llm import hashing as H
from veilstream.llm import repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.drop("kept").collect())


def test_odd(odd, odd_rows):
    assert got(repeats.remove_repeats(odd, 40)) == brute(odd_rows, 40)


def test_whole_length(docs):
    assert got(repeats.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_segments(spark, monkeypatch):
    """Texts cut into segments give the same runs of repeated strings."""
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    rng = random.Random(3)
    common = "".join(rng.choice("abc") for _ in range(700))
    rows = [(k, "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 900))) + common[rng.randint(0, 400) :] + "yz" * rng.randint(0, 200)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(df, 50)) == brute(rows, 50)


def test_empty(empty):
    assert repeats.remove_repeats(empty).collect() == []


def test_one_id_with_several_texts(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcd") for _ in range(600))
    rows = [(1, "begin " + shared), (1, "other text " * 3), (2, shared + " end"), (2, shared[:450]), (None, shared[100:]), (None, "x"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(df)) == brute(rows, 400)


def test_rounds(docs, monkeypatch):
    """Ranks are made in three rounds, at offsets that double up to half the length; each drops what is unique."""
    assert repeats.offsets(400) == (50, 100, 200)
    rounds = []
    real = repeats.reranked

    def seen(rows, rank, behind, name, *more):
        out = real(rows, rank, behind, name, *more)
        before, after = rows.count(), out.count()
        ranks = out.groupBy(name).count()
        assert ranks.where("count < 2").count() == 0
        rounds.append((before, after))
        return out

    monkeypatch.setattr(repeats, "reranked", seen)
    repeats.remove_repeats(docs).count()
    assert len(rounds) == 3 and rounds[0][0] > rounds[0][1] >= rounds[1][0] > rounds[1][1] > 0 and rounds[2][0] > rounds[2][1] > 0


def test_ranks_are_places_in_sorted_order(spark):
    rows = spark.createDataFrame([(i, i % 7, i % 3) for i in range(40)], "i long, r long, n long")
    got = {(x.i % 7, x.i % 3): x.q for x in repeats.reranked(rows, "r", "n", "q").collect()}
    assert [got[k] for k in sorted(got)] == sorted(got.values()) and len(got) == sum(1 for k in range(21) if len(range(k, 40, 21)) > 1)


def colliding(size, base):
    """Two unlike strings of `size` letters and signs with equal sums of byte times power of base, modulo 2**64."""
    p = np.ones(1, int)
    for k in range(7):  # a Thue-Morse word of 128 bytes: its sum has 35 factors of two, the others are found by equal subsets of its places
        p = np.convolve(p, [1] + [0] * ((1 << k) - 1) + [-1])
    value = sum(int(c) * pow(base, i, 1 << 64) for i, c in enumerate(p))
    places = np.array([value * pow(base, i, 1 << 64) % (1 << 64) for i in range(size - 127)], np.uint64)
    chosen = np.random.default_rng(1).integers(0, 2, (1 << 17, len(places))).astype(np.uint64)
    sums = (chosen * places).sum(axis=1, dtype=np.uint64)
    order = np.argsort(sums)
    x, y = next((x, y) for x, y in zip(order, order[1:], strict=False) if sums[x] == sums[y] and (chosen[x] != chosen[y]).any())
    more = np.convolve(chosen[x].astype(int) - chosen[y].astype(int), p)
    first = ord("m") - more // 2
    return bytes(first.tolist()), bytes((first + more).tolist())


def test_strings_made_to_collide(spark):
    """Unlike texts whose bytes have equal sums and whose second halves are equal keep all."""
    a, b = (x.decode() for x in colliding(200, H.BASES[0]))
    rng = random.Random(5)
    tails = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(20000))
    tail = next(t for t in tails if all(repeats.runs([(x + t).encode()], 400)[3][0] == 200 for x in (a, b)))  # the anchor is the half that they share
    rows = [(1, a + tail), (2, b + tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(df)) == brute(rows, 400)


def test_hashes_of_strings_made_to_collide():
    for base in H.BASES:
        a, b = colliding(200, base)
        sums = [H.prefix(np.frombuffer(x, np.uint8), base)[0][-1] for x in (a, b)]
        assert sums[0] == sums[1]
        tail = b"z" * 200
        zero = np.zeros(1, np.int64)
        one, two = (repeats.blocks(zero, zero, zero, [x + tail], 400)[-1] for x in (a, b))
        assert one[0] != two[0]
        parts = [next(repeats._strings(400)(iter([cell(x + tail)]))) for x in (a, b)]
        assert parts[0].column("r")[0] != parts[1].column("r")[0] and parts[0].column("n") == parts[1].column("n")


def cell(text):
    """A batch (row, z, cells) of one text and one string."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zstandard.compress(text)]), pa.array([[{"lo": 0, "hi": 0, "a": 0}]], kind)], names=["row", "z", "cells"])
