"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids and are cut into pieces of at most CAPACITY tokens. Only how often each length occurs
matters for packing, and there are no more than CAPACITY lengths; so the plan is made on that table of counts, which
does not grow with the data, and pieces take their places from the plan by their rank among those of their length.

The plan indexes the sums of one, two and three lengths. The longest length that is left asks the index for the
combination that fills its gap exactly, one part before two before three, and takes it as often as the counts allow;
what finds no exact complement is placed best-fit, longest first. Patterns are taken many at a time, so the plan is
short however many pieces there are.

Edge cases: null or empty text is the closing id alone; a text of any length is cut into full pieces behind a shorter
first one; repeated rows are packed once each; null doc_ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import cut, numbered

CAPACITY = 2048
#: A worker forgets its memo of words beyond this many.
MEMO = 200_000
#: Characters up to which a word is short.
SHORT = 64

#: White space before a space: the two are encoded together.
_RUN = re.compile(r"\s ")
_SPACE, _PART = re.compile(" "), re.compile(r"(?<=\S) (?=\S)")

_loaded: dict[str, _Memo] = {}


class _Memo(dict):
    """From a word to the ids of a space and that word, as little-endian 32-bit bytes.

    The tokenizers library reads the file and encodes all that is long. Short words go through tiktoken with the same
    vocabulary, which takes less than half of the time a word and gives the same ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        byte = {c: b for b, c in enumerate(_byte_signs())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items() if all(c in byte for c in token)}
        #: Strings that stand for one id wherever they are in a text, and split it.
        self.added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")" if self.added else r"(?!)")
        ranks = {t: n for t, n in ranks.items() if t.decode(errors="replace") not in self.added}
        self.short = tiktoken.Encoding("short words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        ids = self.short.encode_ordinary(text) if len(text) <= SHORT else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(" " + word)
        if len(word) < SHORT:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


def encode(texts: list[str], path: str, end: int = 0) -> list[bytes]:
    """Little-endian 32-bit ids of each text, closed by `end`.

    The tokenizer's pattern starts a new word at each space that follows a character other than white space, so a
    text whose spaces are all like that is encoded word by word, and words are remembered. Another text is divided at
    such spaces too, but those before and behind which white space stands stay inside a part. Strings of special tokens are
    their one id, as in a plain call of the library.
    """
    if path not in _loaded:
        _loaded[path] = _Memo(path)
    memo, close = _loaded[path], np.array([end], "<u4").tobytes()

    def ids(t: str) -> bytes:
        if t in memo.added:
            return np.array([memo.added[t]], "<u4").tobytes()
        first, *rest = (_PART if _RUN.search(t) else _SPACE).split(t)
        return b"".join((memo.ids(first) if first else b"", *map(memo.__getitem__, rest)))

    return [b"".join((*map(ids, filter(None, memo.split.split(t))), close)) for t in texts]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _cut_up(path: str, capacity: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, texts in H.batches(part.column(1)):
                rows = []
                keys = zip(part.column(0)[lo:hi].to_pylist(), part.column(2)[lo:hi].to_pylist(), strict=True)
                for (doc, row), ids in zip(keys, encode([t.decode() for t in texts], path), strict=True):
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    for k, at in enumerate([0, *range(first, n, capacity)]):
                        length = first if k == 0 else capacity
                        rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), row))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using each length as often as counts has it."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> int:
        used = np.bincount(pattern, minlength=capacity + 1)
        on = used > 0
        times = int((left[on] // used[on]).min())
        if times:
            left[on] -= used[on] * times
            out.append((pattern, times))
        return times

    take((capacity,))
    for top in range(capacity - 1, 0, -1):
        while left[top]:
            found = _complement(left, top, capacity)
            if found is None or not take((top, *found)):
                break
    # best fit, longest first, a length at a time: an open sequence's gap takes the longest length that fits
    while (lengths := np.flatnonzero(left)).size:
        pattern = [int(lengths[-1])]
        gap = capacity - pattern[0]
        spare = left.copy()
        spare[pattern[0]] -= 1
        while (fit := np.flatnonzero(spare[: gap + 1])).size:
            pattern.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            gap -= int(fit[-1])
        take(tuple(pattern))
    return out


def _complement(left: np.ndarray, top: int, capacity: int) -> tuple[int, ...] | None:
    """One, two or three lengths on hand that fill what `top` leaves free; the longest are used up first."""
    gap = capacity - top
    spare = left.copy()
    spare[top] -= 1
    if gap <= top and spare[gap] > 0:
        return (gap,)
    has = np.flatnonzero(spare[: min(gap, top + 1)] > 0)
    has = has[has > 0]
    rest = gap - has
    ok = (rest > 0) & (rest <= has)
    ok[ok] = spare[rest[ok]] > (rest[ok] == has[ok])
    if ok.any():
        a = int(has[ok][-1])
        return (a, gap - a)
    on = spare > 0
    for a in has[::-1]:
        a = int(a)
        rest = gap - a
        if 3 * a < gap:
            break
        b = has[(has <= a) & (has < rest)]
        c = rest - b
        good = (c > 0) & (c <= b)
        b, c = b[good], c[good]
        used_b = 1 + (b == a)
        used_c = 1 + (c == a) + (c == b)
        fine = on[c] & (spare[b] >= used_b) & (spare[c] >= used_c)
        if fine.any():
            k = np.flatnonzero(fine)[-1]
            return (a, int(b[k]), int(c[k]))
    return None


def _place(table: dict[str, np.ndarray], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        length, rank = part["length"].to_numpy(), part["rank"].to_numpy()
        at = np.searchsorted(table["key"], length * table["scale"] + rank, "right") - 1
        sequence = table["sequence"][at] + rank - table["from"][at]
        cols = [c for c in part.schema.names if c not in ("rank", "row")]
        yield pa.RecordBatch.from_arrays([*[part[c] for c in cols], pa.array(sequence), pa.array(table["offset"][at])], names=[*cols, "sequence_id", "offset"])


def _slots(patterns: list[tuple[tuple[int, ...], int]], total: int) -> dict[str, np.ndarray]:
    """For ranks of each length: where they begin in a pattern's copies, as arrays sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            start = used.get(length, 0)
            rows.append((length, start, sequence, offset))
            used[length] = start + times
            offset += length
        sequence += times
    rows.sort()
    length, start, first, offset = np.array(rows, np.int64).reshape(-1, 4).T
    scale = np.int64(total + 1)
    return {"key": length * scale + start, "from": start, "sequence": first, "offset": offset, "scale": scale}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs (doc_id, text).

    vocabulary: a tokenizer's file in the tokenizers library's format, of a byte-level BPE, which workers can read.
    Special tokens are not added, and their strings in a text are ordinary text. What reaches the driver is the number of pieces of each
    length (at most `capacity` rows); what goes to the tasks is the plan, of about as many rows.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = cut(texts.mapInArrow(_cut_up(vocabulary, capacity), PIECES))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(counts, capacity), sum(counts.values()))
    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "rank", max(64, sum(counts.values()) // 50_000), ties=("row",))
    return ranked.mapInArrow(partial(_place, slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
