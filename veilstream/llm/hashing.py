"""Vectorised hashing of words and substrings of a batch of texts.

Words and lines are hashed eight bytes at a time, each step a non-linear mix of what came before, and by XXH3 where they
are long. Substrings at every position (op 2) use a prefix sum of byte times power of an odd base, modulo 2**64: the hash
of any of them is (prefix[end] - prefix[start]) / base**start. Such sums collide by construction for some strings, so
they only rule out what differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

_U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Odd factors for combining several hashes in order.
STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xC13FA9A902A6328F], _U)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i up to n, kept for later batches."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 21)
        have = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U)))) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = have
    return have


def prefix(a: np.ndarray, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, one longer than a, and the inverse powers."""
    up, down = powers(len(a), base)
    out = np.zeros(len(a) + 1, _U)
    x = a.astype(_U)
    x += _U(1)
    x *= up[: len(a)]
    np.cumsum(x, out=out[1:])
    return out, down


#: Strings of more bytes are hashed one by one.
SHORT = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = BASES[0]) -> np.ndarray:
    """Hashes of the substrings from start to end of data."""
    length = end - start
    h = mix(length.astype(_U) * STEPS[0] + _U(seed))
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))  # the eight bytes from each position
    at = np.flatnonzero((length > 0) & (length <= SHORT))
    step = 0
    while len(at):
        left = length[at] - step
        h[at] = mix(h[at] ^ (eight[start[at] + step] & _MASKS[np.minimum(left, 8)]))
        step += 8
        at = at[left > 8]
    for i in np.flatnonzero(length > SHORT).tolist():
        h[i] = xxh3_64_intdigest(data[start[i] : end[i]], seed)
    return h


def slices(lengths: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def batches(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of a string column with their UTF-8 bytes, about `most` at a time; null is empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    for lo, hi in slices(pc.binary_length(column).to_numpy(zero_copy_only=False), most):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


#: True for the bytes that separate words: ASCII white space.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def words(texts: list[bytes], between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of each text: its text's index, its hash, its start and end in the texts joined by a line feed.

    `between` tells of each byte value if it separates words; a line feed must.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(between[data], prepend=True))
    start, end = edge[0::2], edge[1::2]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return np.searchsorted(firsts, start, "right") - 1, hashes(data, start, end), start, end


def shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each distinct shingle of `size` words; a shorter text is one shingle of all its words."""
    doc, h, _, _ = words(texts)
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, _U)
    for k in range(size):
        out += h[k : k + n] * STEPS[k]
    whole = doc[:n] == doc[size - 1 : size - 1 + n]
    d, s = doc[:n][whole], mix(out[whole])
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.searchsorted(doc, short)
        one = np.zeros(len(short), _U)
        for k in range(size - 1):
            on = count[short] > k
            one[on] += h[at[on] + k] * STEPS[k]
        one += (_U(size) - count[short].astype(_U)) * STEPS[7]
        d, s = np.concatenate((d, short)), np.concatenate((s, mix(one)))
    _, first = np.unique(s + d.astype(_U) * STEPS[6], return_index=True)
    return d[first], s[first]


def exact_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted numbers that are equal where the words are, over all of `texts`.

    No hash takes part: words are numbered by their bytes, and pairs of numbers are numbered again, word by word.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[0::2], edge[1::2]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(firsts, start, "right") - 1
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~blank])]).dictionary_encode()
    word = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    pad = np.where(count > 0, np.maximum(size - count, 0), 0)  # a shorter text is one shingle, filled with a word that no text has
    behind = np.repeat(np.cumsum(count), pad)
    word, doc = np.insert(word, behind, len(named.dictionary)), np.insert(doc, behind, np.repeat(np.arange(len(texts)), pad))
    n = max(0, len(word) - size + 1)
    ids = word[:n]
    for k in range(1, size):
        ids = np.unique(ids * (len(named.dictionary) + 1) + word[k : k + n], return_inverse=True)[1]
    whole = doc[:n] == doc[size - 1 : size - 1 + n]
    ids, doc = ids[whole], doc[:n][whole]
    pairs = np.unique(doc * np.int64(len(word) + 1) + ids)
    return np.split(pairs % np.int64(len(word) + 1), np.cumsum(np.bincount(pairs // np.int64(len(word) + 1), minlength=len(texts)))[:-1])
