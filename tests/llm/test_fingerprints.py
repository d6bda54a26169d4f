import hashlib
import re
import struct
from collections import Counter

import xxhash

from veilstream.llm import fingerprints


def edits(rows):
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    return out


def test_corpus(docs):
    rows = fingerprints.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == edits([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 10 * mean("near_next")


def test_odd(odd, odd_rows):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == len(odd_rows)
    want, got = edits(odd_rows), Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    tied = {3, 4, None, -5}  # ids that several rows have, and those before them: such rows follow each other in an order of their own
    assert {k: v for k, v in got.items() if k[0] not in tied} == {k: v for k, v in want.items() if k[0] not in tied}
    same = {r.doc_id: r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert same[1] == same[2]


def test_edges(spark, empty):
    assert fingerprints.fingerprints(empty).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "TOGETHER", 2)
    rows = [(i * i * 37 % 100_003, f"text number {i} " * (i % 5)) for i in range(400)]
    rows = list(dict(rows).items())
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edits(rows)


SPACES = re.compile(r"[\x20\x09-\x0D]+")


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return seed


def brute(rows):
    """I-Match in plain Python: (id, fingerprint, edited fingerprint, near_edited, near_next) by descending id."""
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    terms = lambda t: {w for w in SPACES.split((t or "").lower()) if w}
    df = Counter(w for _, t in rows for w in terms(t))
    n = len(rows)
    lexicon = {w for w, c in df.items() if fingerprints.SHARES[0] * n <= c <= fingerprints.SHARES[1] * n}

    def subsets(text):
        hashes = sorted(signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in terms(text) & lexicon)
        out = [hashes]
        for place, keeps in enumerate(fingerprints.KEEPS):
            out += [[h for h in hashes if (h >> (8 * place)) & 255 < keep] for keep in keeps]
        return [hash_longs(s) if s else None for s in out], frozenset(terms(text))

    def text_of(p):
        return "-".join("" if h is None else f"{h:x}" for h in p[0]) if any(h is not None for h in p[0]) else None

    def alike(p, q):
        both = [(a, b) for a, b in zip(p[0], q[0], strict=True) if a is not None or b is not None]
        return sum(a == b for a, b in both) / len(both) if both else float(p[1] == q[1])

    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        own, edited = subsets(t), subsets(t[: len(t) - half] + nxt[:half])
        out[i] = (text_of(own), text_of(edited), alike(own, edited), alike(own, subsets(nxt)))
    return out


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(want)
    for r in got:
        own, edited, near_edited, near_next = want[r.doc_id]
        assert r.fingerprint == own or (own is None and re.fullmatch("w[0-9a-f]+", r.fingerprint))
        assert r.edited_fingerprint == edited or (edited is None and re.fullmatch("w[0-9a-f]+", r.edited_fingerprint))
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12
    assert sum(own is not None for own, *_ in want.values()) > len(want) / 2
