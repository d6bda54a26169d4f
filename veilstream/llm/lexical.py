"""Ranked lexical search over a tiered index.

Index. A row for each document holds what its terms contribute to a score, for the terms that items ask for, in tiers:
the highest contributions of the corpus in the first columns, lower ones in the next. Of each term the highest
contribution below a tier is known, its residual bound.

Search. A round reads one tier more. A document's score is at least the sum of what was read of it, and at most that plus
the residual bounds of the item's other terms. Where at most CANDIDATES documents may reach the best 50 by these
bounds, the item is proven: those few are scored from all tiers. Items without such a proof go on to the next round; the
last one reads everything, so its sums are the scores. Each task hands on a bounded number of documents for an item.

Items go in blocks of at most TERMS terms; a block's terms and items are what is sent to tasks.

Edge cases: null and termless texts of items and documents give no rows; a document counts by its row, so repeated rows
are ranked each; equal scores go by ascending doc_id, null ids last; each row of items is an item of its own, also where
item_ids repeat. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import cut, drop_cut, numbered

#: Terms of the items that are searched at once. A longer item stands alone.
TERMS = 1 << 18
#: Shares of all contributions that are in the tiers above a bound; the last tier holds the rest.
TIERS = (0.3, 0.8)
#: Documents that may be left for an item that counts as proven.
CANDIDATES = 200
#: Pairs of a document and an item that are sent to all tasks at most; more are joined with the index by shuffling it.
BROADCAST = 1 << 17
#: Sums that are worked on at a time.
CELLS = 1 << 22

#: Bytes between terms: ASCII but letters and digits.
BETWEEN = ~(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]) | (np.arange(256) > 127))
_U = np.uint64


def _item_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for lo, hi, texts in H.batches(part.column(1)):
            doc, h, _, _ = H.words([t.lower() for t in texts], BETWEEN)
            pairs = np.unique(np.stack((doc.astype(_U), h), 1), axis=0)
            ends = np.cumsum(np.bincount(pairs[:, 0].astype(np.int64), minlength=hi - lo))
            terms = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(pairs[:, 1].copy().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], terms], names=["item_id", "terms"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a list column."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False)


def _list(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list column of the values, which are in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)), pa.array(values))


def _postings(vocabulary: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, texts in H.batches(part.column(1)):
                n = hi - lo
                doc, h, _, _ = H.words([t.lower() for t in texts], BETWEEN)
                count = np.bincount(doc, minlength=n)
                term = np.searchsorted(vocabulary, h)
                on = vocabulary[np.minimum(term, len(vocabulary) - 1)] == h
                key, tf = np.unique(doc[on] * len(vocabulary) + term[on], return_counts=True)
                owner = key // len(vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)[lo:hi], pa.array(count.astype(np.int64)), _list(owner, (key % len(vocabulary)).astype(np.int32), n), _list(owner, tf.astype(np.int64), n)], names=["doc_id", "n", "term", "tf"]
                )

    return run


@dataclass
class Model:
    """What scores need: documents, all their terms, and the weight of each term of the block."""

    documents: int
    total: int
    weight: np.ndarray

    def contributions(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // max(self.total, 1)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _histogram(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contributions by their length in bits and the two bits behind the first."""
        counts = np.zeros(256, np.int64)
        for part in parts:
            owner, term = _lists(part.column("term"))
            c = model.contributions(part.column("n").to_numpy()[owner], term, _lists(part.column("tf"))[1])
            counts += np.bincount(_step(c), minlength=256)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(counts[on])], names=["step", "n"])

    return run


def _step(c: np.ndarray) -> np.ndarray:
    """Steps that grow with c, four for each doubling."""
    share, power = np.frexp(np.maximum(c, 1).astype(np.float64))
    return power.astype(np.int64) * 4 + np.floor((share - 0.5) * 8).astype(np.int64)


def _tiers(model: Model, bounds: list[int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            owner, term = _lists(part.column("term"))
            c = model.contributions(part.column("n").to_numpy()[owner], term, _lists(part.column("tf"))[1])
            tier = np.searchsorted(-np.array(bounds, np.int64), -_step(c))
            columns = [part.column("row"), part.column("doc_id")]
            for k in range(len(bounds) + 1):
                on = tier == k
                columns += [_list(owner[on], term[on], part.num_rows), _list(owner[on], c[on], part.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *[f"{x}{k}" for k in range(len(bounds) + 1) for x in "tc"]])

    return run


@dataclass
class Items:
    """Items by their terms: those of term t are item[start[t]:start[t + 1]]."""

    no: np.ndarray
    start: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, no: np.ndarray, owner: np.ndarray, term: np.ndarray, terms: int) -> Items:
        order = np.argsort(term, kind="stable")
        return cls(no, np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms)))), owner[order])

    def among(self, chosen: set[int]) -> Items:
        keep = np.isin(self.no, np.array(sorted(chosen), np.int64))
        on = keep[self.item]
        term = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return Items.of(self.no[keep], (np.cumsum(keep) - 1)[self.item[on]], term[on], len(self.start) - 1)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item of each term: which of the terms, which item."""
        size = self.start[term + 1] - self.start[term]
        which = np.repeat(np.arange(len(term)), size)
        return which, self.item[np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(len(which))]


def _entries(part: pa.RecordBatch, tiers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and contribution of all entries of the first tiers."""
    got = [(*_lists(part.column(f"t{k}")), _lists(part.column(f"c{k}"))[1]) for k in range(tiers)]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _scan(items: Items, tiers: int, rest: np.ndarray, k: int, most: int):
    """Rows (no, row, doc_id, low, high) of documents that may be among the k best of an item: at most `most` for an item and task.

    rest: residual bounds of the terms; all zero where nothing is left to read, so that low and high are the score.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(items.no)
        term = np.repeat(np.arange(len(items.start) - 1), np.diff(items.start))
        all_rest = np.zeros(count, np.int64)
        np.add.at(all_rest, items.item, rest[term])
        enough = np.zeros(count, np.int64)  # the k-th best low so far
        reach = np.ones(count, np.int64)  # highs below are not handed on
        held, size = [], 0

        def merged() -> list[np.ndarray]:
            item, row, ids, nameless, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((row, ids, nameless, -low, item))
            place = _place(item[order])
            full = order[place == k - 1]
            enough[item[full]] = np.maximum(enough[item[full]], low[full])
            order = np.lexsort((row, ids, nameless, -high, item))
            place = _place(item[order])
            on = order[(place < most) & (high[order] >= enough[item[order]])]
            full = order[place == most - 1]
            reach[item[full]] = np.maximum(reach[item[full]], high[full])
            return [x[on] for x in (item, row, ids, nameless, low, high)]

        for part in parts:
            owner, terms, c = _entries(part, tiers)
            order = np.argsort(owner, kind="stable")
            owner, terms, c = owner[order], terms[order], c[order]
            rows, names = part.column("row").to_numpy(), part.column("doc_id")
            nameless, ids = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
            step = max(1, CELLS // max(count, 1))
            for at in range(0, part.num_rows, step):
                n = min(step, part.num_rows - at)
                a, b = np.searchsorted(owner, [at, at + n])
                which, item = items.spread(terms[a:b])
                cell = (owner[a:b][which] - at) * count + item
                low, known = np.zeros(n * count, np.int64), np.zeros(n * count, np.int64)
                np.add.at(low, cell, c[a:b][which])
                np.add.at(known, cell, rest[terms[a:b]][which])
                low, known = low.reshape(n, count), known.reshape(n, count)
                high = low + all_rest - known
                if n > k:
                    np.maximum(enough, np.partition(low, n - k, axis=0)[n - k], out=enough)
                if n > most:
                    np.maximum(reach, np.partition(high, n - most, axis=0)[n - most], out=reach)
                r, i = np.nonzero((high >= enough) & (high >= reach))
                held.append([i, rows[at + r], ids[at + r], nameless[at + r], low[r, i], high[r, i]])
                size += len(r)
                if size > CELLS:
                    held = [merged()]
                    size = len(held[0][0])
        if held:
            item, row, ids, nameless, low, high = merged()
            yield pa.RecordBatch.from_arrays([pa.array(items.no[item]), pa.array(row), pa.array(ids, mask=nameless), pa.array(low), pa.array(high)], names=["no", "row", "doc_id", "low", "high"])

    return run


def _place(item: np.ndarray) -> np.ndarray:
    start = np.flatnonzero(np.diff(item, prepend=-1))
    return np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))


def _scored(items: Items, tiers: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the pairs of a document and the items in its column `nos`."""
        local = {no: i for i, no in enumerate(items.no.tolist())}
        for part in parts:
            owner, terms, c = _entries(part, tiers)
            which, item = items.spread(terms)
            doc, no = _lists(part.column("nos"))
            cells, of = np.unique(owner[which] * len(items.no) + item, return_inverse=True)
            sums = np.zeros(len(cells) + 1, np.int64)
            np.add.at(sums, of, c[which])
            want = doc * len(items.no) + np.array([local[x] for x in no.tolist()], np.int64)
            at = np.searchsorted(cells, want)
            found = np.append(cells, -1)[at] == want
            yield pa.RecordBatch.from_arrays([pa.array(no), part.column("doc_id").take(pa.array(doc)), pa.array(np.where(found, sums[at], 0))], names=["no", "doc_id", "score"])

    return run


def _block(texts: DataFrame, no: np.ndarray, owner: np.ndarray, hashed: np.ndarray, k: int, proofs: list | None) -> DataFrame:
    """(no, doc_id, score) with at least the k best documents of each item of a block."""
    spark = texts.sparkSession
    vocabulary, term = np.unique(hashed, return_inverse=True)
    if not len(vocabulary):
        return spark.createDataFrame([], "no long, doc_id long, score long")
    postings = cut(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, term array<int>, tf array<long>").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    about = postings.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary))
    counted = postings.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each term of the block
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    model = Model(about["docs"], about["terms"], np.floor(1000 * np.log((2 * about["docs"] + 2) / (2 * df + 1))).astype(np.int64))
    steps = np.zeros(256, np.int64)
    for r in postings.mapInArrow(_histogram(model), "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        steps[r["step"]] = r["n"]
    above = np.cumsum(steps[::-1])[::-1]
    bounds = [int(np.flatnonzero(above >= share * above[0])[-1]) for share in TIERS]
    tiers = len(bounds) + 1
    shape = "row long, doc_id long, " + ", ".join(f"t{i} array<int>, c{i} array<long>" for i in range(tiers))
    index = cut(postings.mapInArrow(_tiers(model, bounds), shape))
    drop_cut(postings)
    rest = np.zeros((tiers, len(vocabulary)), np.int64)  # after reading tier k
    for i in range(1, tiers):
        most = index.select(F.explode(F.arrays_zip(F.col(f"t{i}").alias("t"), F.col(f"c{i}").alias("c"))).alias("e")).groupBy("e.t").agg(F.max("e.c").alias("c")).toArrow()
        rest[i - 1, most["t"].to_numpy()] = most["c"].to_numpy()
    for i in range(tiers - 2, 0, -1):
        rest[i - 1] = np.maximum(rest[i - 1], rest[i])

    items = Items.of(no, owner, term, len(vocabulary))
    pending, parts = set(no.tolist()), []
    for i in range(tiers):
        if not pending:
            break
        last = i == tiers - 1
        now = items.among(pending)
        read = index.select("row", "doc_id", *[f"{x}{j}" for j in range(i + 1) for x in "tc"])
        found = read.mapInArrow(_scan(now, i + 1, rest[i], k, k if last else CANDIDATES + 1), "no long, row long, doc_id long, low long, high long")
        if last:
            parts.append(found.select("no", "doc_id", F.col("low").alias("score")))
            if proofs is not None:
                proofs.append(len(pending))
            break
        found = cut(found)
        by_low = Window.partitionBy("no").orderBy(F.desc("low"), "row")
        enough = found.withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k).groupBy("no").agg(F.when(F.max("r") == k, F.min("low")).otherwise(1).alias("enough"))
        able = cut(found.join(enough, "no").where(F.col("high") >= F.greatest("enough", F.lit(1))).select("no", "row"))
        counts = able.groupBy("no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= CANDIDATES)
        sizes = {r["no"]: r["n"] for r in counts.collect()}  # a number for each item of the block at most
        proven = set(sizes)
        if proofs is not None:
            proofs.append(len(proven))
        if proven:
            few = able.join(counts.select("no"), "no").groupBy("row").agg(F.collect_list("no").alias("nos"))  # items of the block
            few = F.broadcast(few) if sum(sizes.values()) <= BROADCAST else few
            parts.append(index.join(few, "row").mapInArrow(_scored(items, tiers), "no long, doc_id long, score long"))
        pending -= proven
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, proofs: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text); see the module's text.

    proofs, if given, gets the number of items that each round has settled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, "item_id long, terms array<long>")
    asked = cut(asked.where(F.size("terms") > 0).withColumn("no", F.monotonically_increasing_id()))
    asked = cut(numbered(asked, [], [F.col("no")], "start", 64, F.size("terms")).withColumn("block", F.floor(F.col("start") / TERMS)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]:
        held = asked.where(F.col("block") == b).select("no", "terms").toArrow().combine_chunks()  # at most TERMS terms, or one item
        owner, hashed = _lists(held["terms"].combine_chunks())
        found = _block(texts, held["no"].to_numpy(), owner, hashed.astype(np.int64).view(_U), k, proofs)
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.union(ranked.join(asked.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score"))
    return out
