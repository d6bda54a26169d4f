"""Removal of long byte strings that occur more than once, by distributed prefix doubling on sampled positions.

Doubling. A position's rank names the bytes that begin there; equal ranks are equal bytes. In a round at offset k Spark
groups and sorts the pairs (rank of the first k bytes, rank of the k bytes behind them), gives each pair that occurs
more than once its place in that order as the new rank, of 2k bytes, and drops positions whose pair is unique. Offsets
are LENGTH/8, LENGTH/4 and, in the last round, LENGTH/2: then ranks are of LENGTH bytes, the threshold. What stands at an offset
is not sampled as a rule, so its rank is a rolling 64-bit hash of the bytes, as is that of a round's first LENGTH/8.
Rolling hashes collide for strings made for it. They only rule out what differs; what is repeated is told by non-linear
hashes of whole runs and blocks, and of the halves in the last round.

Sampling. Ranks of LENGTH/2 bytes are not worked out at every position: each LENGTH-byte string contains LENGTH/2+1
halves, and the one of least hash (leftmost in ties) is its anchor; strings with the same anchor follow each other, they are a
run. Equal strings have equal anchors at the same place inside, so nothing is lost by doubling anchors (about one
position in a hundred) up to LENGTH/2:
1. After two rounds anchors of a unique rank are gone: no string of their run can occur twice.
2. Runs whose whole bytes occur again are repeated from end to end. Of each such run one stays on as a witness.
3. Runs that differ in their group hold the ends of a match. They are divided into blocks of BLOCK strings, counted from the
   anchor. A block whose core, the bytes that all of its strings share, occurs nowhere else drops out, and one that occurs
   again as a whole is repeated.
4. Only blocks that differ in their core's group go into the last round, with each string in them.

Edge cases: null text is empty; texts shorter than LENGTH keep all; each row is a document of its own, whatever its
doc_id, so the text of repeated rows is removed from all of them; null doc_ids are matched like any other; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import cut, drop_cut

LENGTH = 400
#: Bytes of one text that are worked on at a time.
SEGMENT = 1 << 20
#: Strings of a block, at most.
BLOCK = 16

_U = np.uint64


def offsets(length: int) -> tuple[int, int, int]:
    """The offsets of the rounds."""
    return length // 8, length // 4, length // 2


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Lists of ((text's index, offset in it), bytes) of about SEGMENT bytes; each start of a string is in one of them."""
    at: list[tuple[int, int]] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for o in range(0, len(t) - length + 1, SEGMENT):
            piece = t[o : o + SEGMENT + length - 1]
            at.append((i, o))
            held.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def runs(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same anchor: piece, first and last start in it, the anchor's place, first ranks of the
    anchor and of what is at each offset from it, up to LENGTH/2, and the hash of the run's bytes."""
    one, two, half = offsets(length)
    window = length - half + 1
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sums, down = H.prefix(data)
    rank = H.mix((sums[half:] - sums[:-half]) * down[: len(data) - half + 1])
    key = (rank & _U(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=_U)
    n = len(key) - window + 1
    table = np.concatenate((key, np.full(-len(key) % window, ~_U(0)))).reshape(-1, window)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[window - 1 : window - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pieces])
    first = ends - [len(p) for p in pieces]
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, np.minimum(ends - length + 1, n), -1)
    inside = np.cumsum(inside[:n]) > 0
    change = np.ones(n + 1, bool)
    change[1:n] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | ~inside[1:]
    change[np.minimum(first, n)] = True
    lo = np.flatnonzero(change[:n] & inside)
    hi = np.flatnonzero(change[1:] & inside)
    a = anchor[lo]
    whole = H.mix(H.hashes(data, lo, hi + length) + (hi - lo).astype(_U) * H.STEPS[0] + (a - lo).astype(_U) * H.STEPS[1])
    piece = np.searchsorted(first, lo, "right") - 1
    named = [H.mix((sums[a + e] - sums[a + b]) * down[a + b]) for b, e in ((0, one), (one, two), (two, half))]
    return piece, lo - first[piece], hi - first[piece], a - first[piece], *named, whole


ANCHORS = "row long, lo int, hi int, a int, r long, n1 long, n2 long, u long"


def _anchors(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, texts in _opened(parts):
            for at, pieces in _segments(texts, length):
                piece, first, last, anchor, *hashes = runs(pieces, length)
                where = np.array(at)
                shift = where[piece, 1]
                places = [pa.array((x + shift).astype(np.int32)) for x in (first, last, anchor)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[where[piece, 0]]), *places, *[pa.array(x.view(np.int64)) for x in hashes]], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return run


def _opened(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Rows and their texts, about SEGMENT bytes at a time, of batches (row, z)."""
    opener = zstandard.ZstdDecompressor()
    for part in parts:
        rows, held, size, start = part.column(0).to_numpy(), [], 0, 0
        for i, z in enumerate(part.column(1)):
            held.append(opener.decompress(z.as_py()))
            size += len(held[-1])
            if size >= SEGMENT or i + 1 == part.num_rows:
                yield start, rows[start : i + 1], held
                held, size, start = [], 0, i + 1


def _squeeze(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for part in parts:
        for lo, hi, texts in H.batches(part.column(1)):
            yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "z"])


def _cells(parts: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """From batches (row, z, cells): for each cell its row, first and last start and anchor, and its bytes; about SEGMENT bytes at a time."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        for start, rows, texts in _opened(iter([part])):
            for i, (row, text) in enumerate(zip(rows.tolist(), texts, strict=True)):
                cells = pa.RecordBatch.from_struct_array(part.column(2)[start + i].values)
                lo, hi, a = (cells[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "a"))
                for x, y in H.slices(hi - lo + length):
                    data = [text[b : e + length] for b, e in zip(lo[x:y].tolist(), hi[x:y].tolist(), strict=True)]
                    held.append((np.full(y - x, row), lo[x:y], hi[x:y], a[x:y], data))
                    size += sum(map(len, data))
                    if size >= SEGMENT:
                        yield _together(held)
                        held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple]) -> tuple:
    *numbers, data = zip(*held, strict=True)
    return (*map(np.concatenate, numbers), [c for cells in data for c in cells])


def _numbers(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(lengths) places the index of its part, and its place in it."""
    part = np.repeat(np.arange(len(lengths)), lengths)
    return part, np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def blocks(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, cells: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each block of runs: the run's index, the block's first and last start, the hash of its core and of its bytes."""
    size = min(BLOCK, max(1, length // 4))
    data = np.frombuffer(b"".join(cells), np.uint8)
    sums, down = H.prefix(data, H.BASES[1])
    lengths = np.array([len(c) for c in cells])
    cell, nth = _numbers((a - lo) // size - (a - hi) // size + 1)
    k = ((a - lo) // size)[cell] - nth
    low, high = a[cell] - k * size - size + 1, a[cell] - k * size  # the starts of a whole block
    p0, p1 = np.maximum(low, lo[cell]), np.minimum(high, hi[cell])
    shift = (np.cumsum(lengths) - lengths - lo)[cell]
    core = H.mix((sums[low + length + shift] - sums[high + shift]) * down[high + shift] + k.astype(_U) * H.STEPS[2])
    whole = H.mix(H.hashes(data, p0 + shift, p1 + length + shift) + (p0 - low).astype(_U) * H.STEPS[0] + (p1 - low).astype(_U) * H.STEPS[1])
    return cell, p0, p1, core, whole


def _blocks(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lo, hi, a, cells in _cells(parts, length):
            cell, p0, p1, core, whole = blocks(lo, hi, a, cells, length)
            cols = [row[cell], *[x.astype(np.int32) for x in (p0, p1, a[cell])], core.view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "lo", "hi", "a", "h", "u"])

    return run


def _strings(length: int):
    """For each string in each cell its row, place and pair of ranks."""
    half = length // 2

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lo, hi, _, cells in _cells(parts, length):
            data = np.frombuffer(b"".join(cells), np.uint8)
            lengths = np.array([len(c) for c in cells])
            cell, place = _numbers(hi - lo + 1)
            at = (np.cumsum(lengths) - lengths)[cell] + place
            ranks = H.hashes(data, at, at + half), H.hashes(data, at + half, at + length)
            cols = [row[cell], (lo[cell] + place).astype(np.int32), *[x.view(np.int64) for x in ranks]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "p", "r", "n"])

    return run


def reranked(rows: DataFrame, rank: str, behind: str, name: str, *more: Column) -> DataFrame:
    """One round: rows whose pair (rank, behind) occurs more than once, with the pair's place in sorted order as `name`.

    more: further aggregates of a pair, added to its rows.
    """
    pairs = rows.groupBy(rank, behind).agg(F.count(F.lit(1)).alias("_n"), *more).where("_n > 1").drop("_n")
    order = cut(pairs.orderBy(rank, behind).withColumn(name, F.monotonically_increasing_id()))  # the sort ranges over all partitions
    return rows.join(order, [rank, behind]).drop(rank, behind)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for part in parts:
        for a in range(0, part.num_rows, 500):
            p = part.slice(a, 500)
            rows = []
            for given, z, spans in zip(p.column(0).to_pylist(), p.column(1), p.column(2), strict=True):
                text = opener.decompress(z.as_py())
                n, kept, at, removed, count = len(text), [], 0, 0, 0
                if spans.is_valid:
                    s, e = (x.to_numpy() for x in spans.values.flatten())
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    s, e = s[new], e[np.concatenate((new[1:], [True]))]
                    for i, j in zip(s.tolist(), e.tolist(), strict=True):
                        kept.append(text[at:i])
                        at, removed, count = j, removed + j - i, count + 1
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((given, n, removed, count, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in REMOVED.split(", ")])


def settled(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(row, s, e) of rows (row, lo, hi, a, h, u, mixed) that are repeated from end to end, and (row, cells) of those to be looked at closer.

    h names what rows of a group share, u their bytes; mixed tells whether a group holds more than one u. Rows whose
    bytes occur again are repeated; one of each goes on beside those that differ from all others of their group.
    """
    kinds = cut(rows.where("mixed").groupBy("h", "u").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "lo", "hi", "a")).alias("w")))
    span = ["row", F.col("lo").cast("long").alias("s"), (F.col("hi") + length).cast("long").alias("e")]
    whole = rows.where("not mixed").select(*span).union(rows.where("mixed").join(kinds.where("c > 1").select("h", "u"), ["h", "u"]).select(*span))
    open_ = kinds.groupBy("h").agg(F.min("c").alias("least")).where("least = 1").select("h")
    return whole, kinds.join(open_, "h").select("w.*").groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "a")).alias("cells"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, s, e): pieces of texts (row, z), z compressed, covered by `length`-byte strings that start elsewhere too."""
    texts = texts.select("row", "z")
    mixed = (F.min("u") < F.max("u")).alias("mixed")
    rows = cut(texts.mapInArrow(_anchors(length), ANCHORS))
    met = cut(reranked(rows, "r", "n1", "q"))
    drop_cut(rows)
    again = cut(reranked(met, "q", "n2", "h", mixed))
    drop_cut(met)
    whole, cells = settled(again, length)
    parts = cut(texts.join(cells, "row").select("row", "z", "cells").mapInArrow(_blocks(length), "row long, lo int, hi int, a int, h long, u long"))
    shared = parts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), mixed).where("n > 1").select("h", "mixed")
    shared = cut(parts.join(shared, "h"))
    drop_cut(parts)
    more, cells = settled(shared, length)
    strings = cut(texts.join(cells, "row").select("row", "z", "cells").mapInArrow(_strings(length), "row long, p int, r long, n long"))
    ends = reranked(strings, "r", "n", "t").select("row", F.col("p").cast("long").alias("s"), (F.col("p") + length).cast("long").alias("e"))
    return whole.union(more).union(ends)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text); kept: the bytes that stay."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    squeezed = cut(texts.mapInArrow(_squeeze, "doc_id long, z binary").withColumn("row", F.monotonically_increasing_id()))  # each row's number is given once
    spans = repeated_spans(squeezed, length).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return squeezed.join(spans, "row", "left").select("doc_id", "z", "spans").mapInArrow(_remove, REMOVED)
