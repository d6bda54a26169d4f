"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

Signature. Each distinct shingle gives a permutation of the slots; its j-th slot receives the value j plus a
fraction, and a slot keeps its least value. The ranks of one shingle are thus correlated, which lowers the variance
of the estimate. Rank j+1 is only worked out for texts that still have a slot above j (early stopping).

Links. Texts of equal shingle sets form a class with a number of its own, and the class's smallest (doc_id, hash of
the text) stands for it. Classes that share a band meet in that band's bucket. First each class is compared with one
pivot, the least class of the bucket that looks most like it; verified links are grouped. Then buckets that still hold several groups are compared inside, first
for the likeliest pairs that connect them, then for all pairs of groups that are still apart; pairs of one group aside, so a group of thousands of copies never becomes all of its pairs. Every link is verified on
the words of the full shingle sets.

Edge cases: a null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle is
one shingle; equal rows share their component; a null doc_id is a component of its own (null) and is kept. Where rows
of one doc_id differ in text, each row is linked by its own text and takes the component of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import connecting, cut, drop_cut, unused
from veilstream.llm.components import components
from veilstream.llm.similar import verified

#: Slots, a prime so that a step of any length visits every slot; bands x rows of them are used for candidates.
SLOTS, BANDS, ROWS = 127, 31, 4
#: A pair whose signatures agree in less than this share of slots is not verified. At a similarity of 0.75 the share
#: has a standard deviation of at most 0.039, so this is more than five of them below.
LIKELY = 0.55
#: Bits of the parity sketch. Bit i tells if an odd number of a set's shingles fall on it, so two sketches differ in no
#: more bits than the sets differ in shingles: a pair whose sketches differ too much is not similar, for certain.
PARITY = 4096
#: Buckets of more rows are compared as pairs of blocks of about this many rows.
BUCKET = 3000

_U = np.uint64


def signatures(doc: np.ndarray, h: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots SuperMinHash values of the texts 0 to n-1 from their shingles (doc, h)."""
    out = np.full(n * slots, ~_U(0), _U)
    at = (H.mix(h ^ H.STEPS[1]) % _U(slots)).astype(np.int64)
    step = (H.mix(h ^ H.STEPS[2]) % _U(slots - 1)).astype(np.int64) + 1
    row = doc.astype(np.int64) * slots
    for j in range(slots):
        salt = _U(j * int(H.STEPS[3]) % 2**64)
        value = (H.mix(h + salt) >> _U(8)) | (_U(j) << _U(56))
        np.minimum.at(out, row + at, value)
        open_ = np.unique(row)
        filled = out.reshape(n, slots)[open_ // slots].max(axis=1) < (_U(j + 1) << _U(56))
        if filled.all():
            break
        on = np.zeros(n, bool)
        on[open_[~filled] // slots] = True
        on = on[row // slots]
        h, at, step, row = h[on], (at[on] + step[on]) % slots, step[on], row[on]
    return out.reshape(n, slots)


SIGNED = "doc_id long, tag long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, odd binary"


def _sign(size: int, bands: int, rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, texts in H.batches(part.column(2)):
                doc, h = H.shingles([t.lower() for t in texts], size)
                n = hi - lo
                count = np.bincount(doc, minlength=n)
                sums = np.zeros((2, n), _U)
                for k in range(2):
                    np.add.at(sums[k], doc, H.mix(h ^ H.STEPS[4 + k]))
                sig = signatures(doc, h, n)
                key = np.zeros((n, bands), _U)
                for k in range(rows):
                    key += H.mix(sig[:, k : bands * rows : rows]) * H.STEPS[k]
                key = H.mix(key + np.arange(bands, dtype=_U) * H.STEPS[7]).view(np.int64)
                some = count > 0
                ends = np.cumsum(np.where(some, bands, 0))
                low = (H.mix(sig) & _U(255)).astype(np.uint8)
                bit = (H.mix(h ^ H.STEPS[6]) % _U(PARITY)).astype(np.int64)
                odd = np.packbits(np.bincount(doc * PARITY + bit, minlength=n * PARITY).reshape(n, PARITY) & 1, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0)[lo:hi],
                        part.column(1)[lo:hi],
                        pa.array(count.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(key[some].ravel())),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                        pa.array([r.tobytes() for r in odd], pa.binary()),
                    ],
                    names=["doc_id", "tag", "n_shingles", "s1", "s2", "bands", "sig", "odd"],
                )

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == b).mean(axis=-1) - 1 / 256) / (255 / 256)


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _may_link(odd_a: np.ndarray, odd_b: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """False where the sets, of `total` shingles together, differ in too many for 100 * both >= percent * either."""
    return (100 + percent) * np.bitwise_count(odd_a ^ odd_b).sum(axis=-1, dtype=np.int64) <= (100 - percent) * total


def _estimate(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 2000):
                p = part.slice(lo, 2000)
                est = _agree(_rows(p["sa"], np.uint8), _rows(p["sb"], np.uint8))
                fine = (est >= LIKELY) & _may_link(_rows(p["oa"], np.uint64), _rows(p["ob"], np.uint64), p["na"].to_numpy() + p["nb"].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([p["a"], p["b"], pa.array(est)], names=["a", "b", "est"]).filter(pa.array(fine))

    return run


def _across(percent: int, connect: bool):
    def run(table: pa.Table) -> pa.Table:
        """Likely pairs of different groups in one bucket, or between its blocks `side` 0 and 1; connect: only those that connect the groups."""
        table = table.sort_by("doc").combine_chunks()
        sig, odd = (_rows(table[c].combine_chunks(), k) for c, k in (("sig", np.uint8), ("odd", np.uint64)))
        doc, group, side, n = (table[c].to_numpy() for c in ("doc", "grp", "side", "n_shingles"))
        two = (side == 1).any()
        a, b, est = [], [], [np.zeros(0)]
        for i in np.flatnonzero(side == 0) if two else range(len(doc) - 1):
            others = np.flatnonzero((group != group[i]) & (side == 1)) if two else i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
            others = others[_may_link(odd[others], odd[i], n[others] + n[i], percent)]
            agree = _agree(sig[others], sig[i])
            near = others[agree >= LIKELY]
            a.append(np.full(len(near), i))
            b.append(near)
            est.append(agree[agree >= LIKELY])
        x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
        if connect:
            on = connecting(x, y, np.concatenate(est), group)
            x, y = x[on], y[on]
        x, y = doc[x], doc[y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, n_shingles, s1, s2) of docs, and their classes (n_shingles, s1, s2, component, component_id).

    tag is a hash of the text; component is a number for each group, component_id the smallest doc_id in it. Rows
    without shingles or without a doc_id have no class.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_sign(size, BANDS, ROWS), SIGNED))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    # the number of a class is given once, as its row is written
    classes = some.groupBy(*same).agg(F.min(F.struct("doc_id", "tag")).alias("m"))
    classes = cut(classes.select(*same, F.col("m.doc_id").alias("doc_id"), F.col("m.tag").alias("tag"), F.monotonically_increasing_id().alias("doc")))
    reps = cut(some.join(classes, [*same, "doc_id", "tag"]).select("doc", "doc_id", "tag", "n_shingles", "bands", "sig", "odd"))
    if reps.count() != classes.count():  # equal rows occur
        reps = reps.dropDuplicates(["doc"])
    sig_a, sig_b = (reps.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")

    rows = reps.select("doc", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a")).where("n > 1").select("key", "a")
    member = cut(rows.join(shared, "key").select("key", "a", F.col("doc").alias("b")))  # rows of buckets with company
    stars = member.where("a <> b").select("a", "b").distinct()
    likely = stars.join(sig_b, "b").join(sig_a, "a").mapInArrow(_estimate(percent), "a long, b long, est double")
    best = likely.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")

    links = cut(verified(best, texts, classes, size, percent))
    groups = components(links)

    # buckets in which some group is not yet one with the others: first the pairs that would connect them, then all that is left
    done = best
    for connect in (True, False):
        labelled = cut(member.select("key", F.col("b").alias("doc")).join(groups, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("grp")))
        mixed = labelled.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
        open_ = cut(labelled.join(mixed, "key").select("key", "doc", "grp", "n"))
        more = cut(_cross(open_, reps, percent, connect).join(done, ["a", "b"], "left_anti"))
        new = cut(verified(more, texts, classes, size, percent))
        drop_cut(labelled), drop_cut(open_)
        if new.limit(1).count():
            links = links.union(new)
            groups = components(links)
        done = done.union(more)
    drop_cut(member)
    by_class = cut(classes.join(groups, F.col("doc") == F.col("node"), "left").select(*same, "doc_id", F.coalesce("component", "doc").alias("component")))
    least = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return signed.select("doc_id", "tag", *same), cut(by_class.join(least, "component").select(*same, "component", "component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); see the module's text."""
    rows, classes = _grouped(docs, size, percent)
    same = [rows[c] == classes[c] for c in ("n_shingles", "s1", "s2")]
    out = rows.join(classes, [rows["doc_id"].isNotNull(), *same], "left").select("doc_id", rows["n_shingles"], F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each group: of its smallest doc_id the text of least hash. Columns as given.

    Rows without words are linked with nothing and stay, but of rows equal in doc_id and text one stays. Rows without a
    doc_id all stay.
    """
    rows, classes = _grouped(docs, size, percent)
    same = [rows[c] == classes[c] for c in ("n_shingles", "s1", "s2")]
    at = F.struct(rows["doc_id"], "tag")
    first = rows.join(classes, same).where(rows["doc_id"].isNotNull()).groupBy("component").agg(F.min(at).alias("m")).select("m.*")
    blank = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id", "tag")
    i, t = unused(docs.columns, "kept_id", "kept_tag")
    chosen = rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).join(first.union(blank).distinct(), ["doc_id", "tag"])
    chosen = cut(chosen.select(F.col("doc_id").alias(i), F.col("tag").alias(t), "n"))
    named = docs.where("doc_id is not null").withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64(F.col("text").cast("string"))})
    kept = named.join(chosen.select(i, t), [i, t], "left_semi")
    if chosen.where("n > 1").limit(1).count():  # rows that occur more than once: only these are brought together
        more = chosen.where("n > 1").select(i, t)
        kept = kept.join(more, [i, t], "left_anti").union(kept.join(more, [i, t], "left_semi").dropDuplicates([i, t]))
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def _cross(open_: DataFrame, reps: DataFrame, percent: int, connect: bool = False) -> DataFrame:
    """Distinct likely pairs of different groups in the buckets of open_; connect: of each bucket only those that connect its groups."""
    wide = reps.select("doc", "n_shingles", "sig", "odd")
    small = open_.where(F.col("n") <= BUCKET).select("key", "doc", "grp").withColumn("side", F.lit(0))
    shape = "a long, b long"
    large = open_.where(F.col("n") > BUCKET)
    if large.limit(1).count():
        # every block of rows meets every block, each pair of blocks in a task of its own; a large group has blocks of
        # its own, so that those need not meet
        sizes = large.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("g"))
        own = F.xxhash64("grp", F.pmod(F.xxhash64("doc"), F.ceil(F.col("g") / BUCKET)))
        blocks = large.join(sizes, ["key", "grp"]).withColumn("blk", F.when(F.col("g") > BUCKET, own).otherwise(F.pmod(F.xxhash64("grp"), F.ceil(F.col("n") / BUCKET))))
        blocks = cut(blocks.select("key", "doc", "grp", "blk"))
        held = blocks.groupBy("key", "blk").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        other = held.select("key", F.col("blk").alias("o"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
        meet = held.join(other, "key").where(F.least("lo", "olo") < F.greatest("hi", "ohi")).select("key", "blk", "o")
        met = blocks.join(meet, ["key", "blk"])
        met = met.select(F.xxhash64("key", F.least("blk", "o"), F.greatest("blk", "o")).alias("key"), "doc", "grp", F.when(F.col("blk") > F.col("o"), 1).otherwise(0).alias("side"))
        small = small.union(met)
    return small.join(wide, "doc").groupBy("key").applyInArrow(_across(percent, connect), shape).distinct()
