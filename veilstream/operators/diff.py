"""Text comparison: word differences, their HTML, and moved passages."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.text import html, once
from veilstream.sources.tables import unlisted

OPS = "array<struct<kind:string,text:string>>"


def tokenize(text: Column) -> Column:
    """White space, words and single signs."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), 1)


#: Numbers that the furthest points of two texts may take; texts that differ more are compared by their whole table.
POINTS = 1 << 25


def _furthest(x: np.ndarray, y: np.ndarray) -> list[np.ndarray] | None:
    """For each number d of steps, the furthest place in x on the diagonals -d, -d + 2, … d; the last d is the difference of x and y.

    None if that takes more than POINTS numbers.
    """
    n, m, held = len(x), len(y), 0
    found: list[np.ndarray] = []
    while True:
        d = len(found)
        held += d + 1
        if held > POINTS:
            return None
        k = np.arange(-d, d + 1, 2)
        if d:
            before = found[-1]
            at = np.maximum(np.append(before, -1), np.append(-1, before + 1))
        else:
            at = np.zeros(1, np.int32)
        at = np.where((at < 0) | (at > n) | (at - k > m), np.int32(-(1 << 30)), at).astype(np.int32)
        on = np.flatnonzero(at >= 0)
        for _ in range(8):  # most runs of equal tokens off the way are short
            on = on[(at[on] < n) & (at[on] - k[on] < m)]
            on = on[x[at[on]] == y[at[on] - k[on]]]
            if not len(on):
                break
            at[on] += 1
        for j in on.tolist():
            i, step = int(at[j]), 64
            while i < n and i - k[j] < m:
                a, b = x[i : i + step], y[i - k[j] : i - k[j] + step]
                size = min(len(a), len(b))
                other = np.flatnonzero(a[:size] != b[:size])
                i += int(other[0]) if len(other) else size
                if len(other):
                    break
                step *= 2
            at[j] = i
        found.append(at)
        if abs(n - m) <= d and (n - m + d) % 2 == 0 and at[(n - m + d) // 2] >= n:
            return found


#: Bits of the table of lengths that _way_by_bits keeps; larger tables are left to the other two.
BITS = 1 << 24
#: Moves of a batch that leaves an Arrow pass.
MOVES_AT_ONCE = 4000


def _way_by_bits(x: list[int], y: list[int]) -> list[str]:
    """The kinds of steps from the table of lengths, as _way_by_table reads it, of which a row is one number: where a row's length grows, its bit is 0."""
    places: dict[int, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    row = full = (1 << len(y)) - 1
    rows = [row]
    for t in x:
        on = row & places.get(t, 0)
        row = ((row + on) | (row ^ on)) & full
        rows.append(row)
    i, j, steps = len(x), len(y), []
    grows = lambda k: j - (rows[k] & ((1 << j) - 1)).bit_count()
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            steps.append("equal")
            i, j = i - 1, j - 1
        elif i and (not j or not rows[i] >> (j - 1) & 1 or rows[i] == rows[i - 1] or grows(i) == grows(i - 1)):
            steps.append("del")
            i -= 1
        else:
            steps.append("ins")
            j -= 1
    return steps


def _way_by_points(x: np.ndarray, y: np.ndarray, found: list[np.ndarray]) -> list[str]:
    """The kinds of steps, read from the end: the place before a deletion can be reached with one step less, else it is an insertion."""
    i, j, d, steps = len(x), len(y), len(found) - 1, []
    a, b = x.tolist(), y.tolist()
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            steps.append("equal")
            i, j = i - 1, j - 1
            continue
        d -= 1
        at = (i - 1 - j + d) // 2
        if i and 0 <= at <= d and found[d][at] >= i - 1:
            steps.append("del")
            i -= 1
        else:
            steps.append("ins")
            j -= 1
    return steps


def _way_by_table(x: np.ndarray, y: np.ndarray) -> list[str]:
    """The same from the table of lengths, of which every root-th row is kept; the rows between are worked out again where the way back passes."""

    def row_after(row: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], np.where(y == x[i - 1], row[:-1] + 1, 0)), out=out[1:])
        return out

    apart = max(1, math.isqrt(len(x)))
    row = np.zeros(len(y) + 1, np.int32)
    kept = [row]
    for i in range(1, len(x) + 1):
        row = row_after(row, i)
        if i % apart == 0:
            kept.append(row)
    i, j, steps = len(x), len(y), []
    while i or j:
        base = max(i - 1, 0) // apart * apart
        table = [kept[base // apart]]
        for k in range(base + 1, i + 1):
            table.append(row_after(table[-1], k))
        while i > base or (i == 0 and j):
            if i and j and x[i - 1] == y[j - 1]:
                steps.append("equal")
                i, j = i - 1, j - 1
            elif i and (not j or table[i - 1 - base][j] >= table[i - base][j - 1]):
                steps.append("del")
                i -= 1
            else:
                steps.append("ins")
                j -= 1
    return steps


def _runs(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Runs of one kind along a longest common subsequence; among equal ways deletions come first when read from the end.

    Time and memory grow with the square of the differences, not of the lengths, as long as there are few.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(t, len(ids)) for t in s[head : len(s) - tail]] for s in (a, b))
    if len(x) * len(y) <= BITS:
        steps = _way_by_bits(x, y)
    else:
        x, y = np.array(x, np.int64), np.array(y, np.int64)
        found = _furthest(x, y)
        steps = _way_by_table(x, y) if found is None else _way_by_points(x, y, found)
    out: list[tuple[str, str]] = []
    i = j = 0
    kinds = ["equal"] * head + steps[::-1] + ["equal"] * tail
    for kind, group in itertools.groupby(kinds):
        n = sum(1 for _ in group)
        out.append((kind, "".join(b[j : j + n] if kind == "ins" else a[i : i + n])))
        i, j = i + n * (kind != "ins"), j + n * (kind != "del")
    return out


def _ops(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "text": t} for k, t in _runs(list(a), list(b))] for a, b in zip(old, new, strict=True)])


def word_diff(pairs: DataFrame) -> DataFrame:
    """pairs (…, old, new) with ops: what stays, goes and comes, in order, neighbours of one kind as one. Null texts are empty."""
    old, new = (tokenize(F.coalesce(c, F.lit(""))) for c in ("old", "new"))
    return pairs.withColumn("ops", F.pandas_udf(_ops, OPS)(old, new))


def diff_html(ops: Column) -> Column:
    tag = lambda o, name: F.concat(F.lit(f"<{name}>"), html(o["text"]), F.lit(f"</{name}>"))
    return F.array_join(F.transform(ops, lambda o: F.when(o["kind"] == "del", tag(o, "del")).when(o["kind"] == "ins", tag(o, "ins")).otherwise(html(o["text"]))), "")


def mutations(diffs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, i, kind, text, start, end, at): deletions at their place in the old text, insertions in the new one; `at` is where they stand in the other."""
    kind = diffs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ops, owners = unlisted(part.column(1))
            own, n, what = np.array(owners, np.int64), pc.utf8_length(ops["text"]).to_numpy(zero_copy_only=False).astype(np.int64), ops["kind"].to_numpy(zero_copy_only=False)
            first = np.searchsorted(own, own)

            def before(counts: np.ndarray) -> np.ndarray:
                past = np.concatenate(([0], np.cumsum(np.where(counts, n, 0))))
                return past[:-1] - past[first]

            gone, old, new = what == "del", before(what != "ins"), before(what != "del")
            start = np.where(gone, old, new)
            cols = [np.arange(len(own), dtype=np.int32) - first.astype(np.int32), ops["kind"], ops["text"], start, start + n, np.where(gone, new, old)]
            out = pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), *[c if isinstance(c, pa.Array) else pa.array(c) for c in cols]], names=[key, "i", "kind", "text", "start", "end", "at"])
            yield out.filter(pa.array(what != "equal"))

    return diffs.select(key, "ops").where("ops is not null").mapInArrow(run, f"`{key}` {kind}, i int, kind string, text string, start long, end long, at long")


def normal_block(text: Column) -> Column:
    """Text without clause numbers and signs, in lower case."""
    plain = F.regexp_replace(F.lower(text), r"(?Um)^\s*\d+(?:\.\d+)*\.?\s+", " ")
    return F.btrim(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Distinct words in common, over the larger number of distinct words."""
    x, y = (F.array_distinct(F.filter(F.split(normal_block(c), " "), lambda w: w != "")) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))


_HEADING = re.compile(r"\s*\d+\.\s+\S", re.ASCII)


def blocks(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, start, end, text, norm): sections that begin with a numbered heading and have a sub-clause, 80 characters and 10 words at least."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for i in range(part.num_rows):
                body, at, heads = part.column(1)[i].as_py(), 0, []
                for line in body.split("\n"):
                    if _HEADING.match(line):
                        heads.append(at)
                    at += len(line) + 1
                rows += [(i, n, s, e - 1, body[s : e - 1]) for n, (s, e) in enumerate(zip(heads, [*heads, at][1:], strict=True), 1)]
            own, *cols = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[key, "block", "start", "end", "text"])

    got = texts.select(key, "text").where("text is not null").mapInArrow(run, f"`{key}` {kind}, block long, start long, end long, text string")
    got = once(got.where(F.col("text").rlike(r"(?m)^\s*\d+\.\d+") & (F.char_length("text") >= 80)), norm=normal_block(F.col("text")))
    return got.where(F.size(F.split("norm", " ")) >= 10)


def moved_blocks(old: DataFrame, new: DataFrame, key: str = "doc_id", least: int = 60) -> DataFrame:
    """Blocks that occur once on either side, are at least `least` characters away, and pass another such block."""
    digest = F.substring(F.unhex(F.sha2("norm", 256)), 1, 16).alias("_h")  # blocks are told apart within one text
    side = lambda df, old: blocks(df, key).select(key, digest, F.lit(old).alias("_old"), F.struct("block", "start", "end").alias("_b"))
    both = side(old, True).union(side(new, False)).where(F.col(key).isNotNull()).repartition(key)  # all that follows is within a text
    equal = Window.partitionBy(key, "_h")
    of = lambda which: F.when(F.col("_old") == which, F.col("_b"))
    both = both.select(key, "_old", "_b", F.count(of(True)).over(equal).alias("_n"), F.count(of(False)).over(equal).alias("_m"), F.max(of(True)).over(equal).alias("_o")).where("_n = 1 and _m = 1 and not _old")
    both = both.select(key, *[F.col(f"{c}.{n}").alias(f"{name}_{n}") for c, name in (("_o", "old"), ("_b", "new")) for n in ("block", "start", "end")])
    order = Window.partitionBy(key).orderBy("new_block")
    before, after = F.lag("old_block").over(order), F.lead("old_block").over(order)
    turned = F.coalesce(before > F.col("old_block"), F.lit(False)) | F.coalesce(after < F.col("old_block"), F.lit(False))
    return both.withColumn("_t", turned).where(F.col("_t") & (F.abs(F.col("new_start") - F.col("old_start")) >= least)).drop("_t")


def _prefixes(rows: list[set[str]], least: float) -> list[list[str]]:
    """The rarest n - ceil(least * n) + 1 of the words of each row. Two rows that are alike share one of them, so a word that all rows
    have brings no pair, unless all of a row's words are such."""
    often = Counter(w for words in rows for w in words)
    return [sorted(words, key=lambda w: (often[w], w))[: len(words) - math.ceil(least * len(words) - 1e-9) + 1] for words in rows]


def _pair_up(gone: list[tuple], come: list[tuple], least: float) -> Iterator[tuple[int, int, float, int]]:
    """(d, i, sim, n): one-to-one moves of one document's changes (number, characters, words): the longest deletion first takes the insertion most like it."""
    first = _prefixes([words for *_, words in (*gone, *come)], least)
    under: dict[str, list[int]] = {}
    for k, words in enumerate(first[len(gone) :]):
        for w in words:
            under.setdefault(w, []).append(k)
    taken, done = set(), set()
    for k in sorted(range(len(gone)), key=lambda k: (-gone[k][1], gone[k][0])):
        d, n, words = gone[k]
        if d in done:
            continue
        best = None
        for j in {j for w in first[k] for j in under.get(w, ())}:
            i, _, other = come[j]
            size = max(len(words), len(other))
            if i not in taken and min(len(words), len(other)) >= least * size - 1e-9:
                sim = len(words & other) / size
                if sim >= least and (best is None or (-sim, i) < best):
                    best = -sim, i
        if best:
            done.add(d), taken.add(best[1])
            yield d, best[1], -best[0], n


def _moves(least: float):
    """A pass over rows (key, i, gone, n, norm) in which those of a document follow each other; it holds one document's changes at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[ahead.schema.names[0], "d", "i", "sim", "n"])

        ahead = next(parts, None)
        if ahead is None:
            return
        kinds, parts, out = (ahead.schema.types[0], pa.int32(), pa.int32(), pa.float64(), pa.int32()), itertools.chain([ahead], parts), []
        for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
            sides: tuple[list, list] = [], []
            for _, i, gone, n, norm in group:
                words = set(norm.split(" ")) - {""}
                if len(words) >= 3:
                    sides[not gone].append((i, n, words))
            if all(sides):
                for move in _pair_up(*sides, least):
                    out.append((key, *move))
                    if len(out) >= MOVES_AT_ONCE:
                        yield batch()
        if out:
            yield batch()

    return run


def likely_moves(changes: DataFrame, key: str = "doc_id", least: float = 0.82) -> DataFrame:
    """(key, d, i, sim, n): deletions and insertions whose words agree, each in one move at most: the longest deletion first takes what is most like it.

    Changes are shuffled once, as the text that their words are taken from; words, of which there are many times as many, are not.
    """
    kind = dict(changes.dtypes)[key]
    rows = changes.where(F.col(key).isNotNull() & F.col("kind").isin("del", "ins") & F.col("text").isNotNull())
    rows = rows.select(key, F.col("i").cast("int").alias("i"), (F.col("kind") == "del").alias("gone"), F.char_length("text").alias("n"), normal_block(F.col("text")).alias("norm"))
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(_moves(least), f"`{key}` {kind}, d int, i int, sim double, n int")


def uncovered(changes: DataFrame, moves: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes that no moved range (key, kind, start, end) covers."""
    m = moves.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col(key) == F.col("_k")) & (F.col("kind") == F.col("_kind")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    return changes.join(m, on, "left_anti")
