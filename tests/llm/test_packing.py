import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilstream.llm import packing


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def held(rows, texts):
    """Every piece is right, and sequences are gapless and not too long."""
    want = Counter()
    for (doc, _), ids in zip(texts, ids_of(t or "" for _, t in texts), strict=True):
        first, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            part = ids[at : at + (first if k == 0 else 2048)]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            at, k = at + len(part), k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in rows) // 2048)


def test_odd(odd, odd_rows):
    held(packing.pack(odd).collect(), odd_rows)


def test_corpus(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    n, least = held(packing.pack(docs).collect(), texts)
    assert n <= least * 1.03 + 1


def test_empty(empty):
    assert packing.pack(empty).collect() == []


def test_plan_uses_each_length_once():
    rng = random.Random(1)
    counts = {rng.randint(1, 2048): rng.randint(1, 10**9) for _ in range(700)}
    plan = packing.plan(counts)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 2048 and times > 0
        for length in pattern:
            used[length] += times
    assert used == counts
    assert len(plan) < 6 * 2048
    total, large = sum(k * v for k, v in counts.items()), sum(v for k, v in counts.items() if k > 1024)
    assert sum(t for _, t in plan) <= max(total / 2048, large) * 1.1 + 2


def test_exact_complements_leave_no_gap():
    for counts in ({1000: 5, 1048: 5, 2048: 3}, {900: 7, 700: 7, 448: 7}, {900: 2, 600: 2, 400: 2, 148: 2}, {500: 3, 548: 1}, {512: 4000}, {1024: 10}):
        plan = packing.plan(counts)
        assert all(sum(p) == 2048 for p, _ in plan), (counts, plan)


def test_words_are_encoded_like_texts():
    rng = random.Random(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "b!", "\t", "é", "'s", "3", "<|endoftext|>", "\r", "\x1c", "\x85"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert packing.encode(texts, path) == [np.array(i, "<u4").tobytes() for i in ids_of(texts)]


def test_long_runs_of_white_space(spark):
    rng = random.Random(3)
    texts = [c * 2_000_000 for c in " \n\t"] + [" \n" * 500_000, "a" + " " * 300_000 + "b", "".join(rng.choice(" \n\t\u00a0x") for _ in range(300_000)), "ab" * 500_000]
    assert packing.encode(texts, public_tokenizers.path("byte_bpe_50k.json")) == [np.array(i, "<u4").tobytes() for i in ids_of(texts)]
    rows = list(enumerate(texts[:1]))
    held(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_special_strings_are_as_in_a_plain_call():
    rng = random.Random(12)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "word", " the", "é", "😀", "12", "<|endoftext|><|endoftext|>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert sum("<|endoftext|>" in t for t in texts) > 500
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, public_tokenizers.path("byte_bpe_50k.json"))] == ids_of(texts)
