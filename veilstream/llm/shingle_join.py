"""Similarity join on word shingles by an R-tree over vectors of group counts.

Points. The distinct shingles of a text are hashed into GROUPS groups, and the counts of the groups are the text's point.
Two sets have at most as many shingles in common as the sum over groups of the smaller count, so a pair whose sum is
too small is not similar, for certain. The same holds for boxes of points, with the largest counts and the smallest sizes.

Tree. Count vectors alone leave pairs of all texts of similar size, since boxes in many dimensions overlap. So the
tree's topmost level deals points out by tokens: each text goes under the first n - ceil(0.85 n) + 1 of its n shingles in
one order of all shingles, and two similar texts meet under at least one of them. Shingles that a sample of the texts shows
to be frequent stand last in that order, so a common passage brings no unlike texts together; any order gives the same
links. Under a token stand leaves of points of one class of sizes with their boxes, in a leaf boxes of 16 points.

Points that pass are held against finer ones: the parities of FINE groups, in which two sets differ no more often than
they differ in shingles, and for sets of over WIDE shingles those of at least twice as many groups as they have shingles.

Links. First each point under a token meets the least one there. Pairs that pass the bounds are verified on the words
themselves, the likeliest of each point first, and verified links are grouped. Then the trees of tokens that still hold
several groups are joined with themselves: pairs of leaves, of boxes, of points, those of one group aside. A first
join gives only the likeliest pairs that would connect the groups, a second one all pairs of groups that are still
apart. So a group of thousands of copies never becomes all of its pairs, and no link between groups is lost.

Edge cases: a null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle is
one shingle; equal rows share their component; a null doc_id is a component of its own (null). Where rows of one doc_id
differ in text, each row is linked by its own text and takes the component of that. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm import hashing as H
from veilstream.llm.common import connecting, cut, drop_cut
from veilstream.llm.components import components
from veilstream.llm.similar import verified

GROUPS, FINE, WIDE = 64, 2048, 1024
#: Points of a leaf that is joined in one task, and of the boxes in it.
LEAF, BOX = 512, 16
#: One text in SAMPLE is looked at for frequent shingles: those in at least FREQUENT of these texts, the most frequent
#: MOST at most. They set the order of shingles only.
SAMPLE, FREQUENT, MOST = 64, 4, 1 << 16

_U = np.uint64
POINTS = "doc_id long, tag long, n_shingles long, s1 long, s2 long, point binary, odd binary, wide binary, tokens array<long>"


def _shingle_rows(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, _, texts in H.batches(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(H.shingles([t.lower() for t in texts], size)[1].view(np.int64))], names=["h"])

    return run


def frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the shingles that are in many of a sample of the texts; at most MOST."""
    some = texts.where(F.pmod("tag", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_shingle_rows(size), "h long")
    found = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST).select("h").toArrow()
    return np.sort(found["h"].to_numpy().astype(np.int64).view(_U))


def _parities(h: np.ndarray, bits: int) -> bytes:
    """For each of `bits` groups (a power of two) whether an odd number of the hashes fall on it."""
    bit = (h & _U(bits - 1)).astype(np.int64)
    out = np.zeros(bits // 8, np.uint8)
    np.bitwise_xor.at(out, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return out.tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many groups two sets' parities differ; the finer groups are joined to those of the other."""
    x, y = (np.frombuffer(z, "<u8") for z in (a, b))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, least), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _points(size: int, percent: int, common: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # sets of this task that have been dealt out
        for part in parts:
            for lo, hi, texts in H.batches(part.column(2)):
                n = hi - lo
                doc, h = H.shingles([t.lower() for t in texts], size)
                count = np.bincount(doc, minlength=n)
                sums = np.zeros((2, n), _U)
                for k in range(2):
                    np.add.at(sums[k], doc, H.mix(h ^ H.STEPS[4 + k]))
                group = (H.mix(h ^ H.STEPS[6]) % _U(GROUPS)).astype(np.int64)
                point = np.bincount(doc * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS).astype("<u4")
                bit = (H.mix(h ^ H.STEPS[3]) % _U(FINE)).astype(np.int64)
                odd = np.zeros((n, FINE // 8), np.uint8)
                np.bitwise_xor.at(odd, (doc, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
                often = np.isin(h, common)
                order = np.lexsort((H.mix(h ^ H.STEPS[1]), often, doc))
                place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                wide: list[bytes | None] = [None] * n
                for i in np.flatnonzero(count > WIDE).tolist():
                    own = H.mix(h[order[count[:i].sum() :][: count[i]]] ^ H.STEPS[7])
                    wide[i] = _parities(own, 1 << int(2 * count[i] - 1).bit_length())
                most = count - (percent * count + 99) // 100 + 1
                first = np.zeros(n, bool)
                for i, name in enumerate(zip(sums[0].tolist(), sums[1].tolist(), strict=True)):
                    if count[i] and name not in seen:
                        seen.add(name)
                        first[i] = True
                owner = doc[order]
                on = (place < most[owner]) & first[owner]
                ends = np.cumsum(np.bincount(owner[on], minlength=n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0)[lo:hi],
                        part.column(1)[lo:hi],
                        pa.array(count.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([r.tobytes() for r in point], pa.binary()),
                        pa.array([r.tobytes() for r in odd], pa.binary()),
                        pa.array(wide, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(h[order][on].view(np.int64))),
                    ],
                    names=["doc_id", "tag", "n_shingles", "s1", "s2", "point", "odd", "wide", "tokens"],
                )

    return run


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, GROUPS)


def _odd(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, FINE // 64)


def _both(odd_a: np.ndarray, odd_b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How many shingles two sets of `total` together have in common at most, by the parities of the fine groups."""
    return (total - np.bitwise_count(odd_a ^ odd_b).sum(axis=-1, dtype=np.int64)) // 2


def _enough(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """If sets of `total` shingles together, `shared` of them at most in both, may be similar enough."""
    return (100 + percent) * shared.astype(np.int64) >= percent * total


def _bounded(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 4000):
                p = part.slice(lo, 4000)
                total = p["na"].to_numpy() + p["nb"].to_numpy()
                shared = np.minimum(np.minimum(_rows(p["pa"]), _rows(p["pb"])).sum(axis=1, dtype=np.int64), _both(_odd(p["oa"]), _odd(p["ob"]), total))
                fine = pa.array(_enough(shared, total, percent))
                yield pa.RecordBatch.from_arrays([p["a"], p["b"], pa.array(shared / (total - shared).clip(1))], names=["a", "b", "est"]).filter(fine)

    return run


def _narrow(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            total = (p["na"].to_numpy() + p["nb"].to_numpy()).tolist()
            keep = [x is None or y is None or (100 + percent) * (t - _apart(x, y)) >= 2 * percent * t for x, y, t in zip(p["wa"].to_pylist(), p["wb"].to_pylist(), total, strict=True)]
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def narrowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that the parities of large sets do not rule out."""
    one, two = (classes.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_narrow(percent), "a long, b long")


def _box(table: pa.Table) -> pa.Table:
    """The box of one leaf: its largest counts, the least and the largest size, the least and the largest group."""
    n, grp = table["n_shingles"].to_numpy(), table["grp"].to_numpy()
    hi = _rows(table["point"]).max(axis=0).astype("<u4").tobytes()
    return pa.table({"key": table["key"][:1], "level": table["level"][:1], "leaf": table["leaf"][:1], "hi": pa.array([hi], pa.binary()), "least": [int(n.min())], "most": [int(n.max())], "g0": [int(grp.min())], "g1": [int(grp.max())]})


BOX_ROW = "key long, level int, leaf long, hi binary, least long, most long, g0 long, g1 long"


def _meeting(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of leaves whose boxes allow a link."""
        for p in parts:
            shared = np.minimum(_rows(p["hi"]), _rows(p["hi2"])).sum(axis=1, dtype=np.int64)
            fine = _enough(shared, p["least"].to_numpy() + p["least2"].to_numpy(), percent)
            yield p.select(["key", "leaf", "leaf2"]).filter(pa.array(fine))

    return run


def _unit(point: np.ndarray, odd: np.ndarray, n: np.ndarray, grp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of pairs that may be linked and are of different groups, all of one leaf or between the sides 0 and 1, and their highest similarity."""
    two = side.any()
    order = np.lexsort((n, side))
    point, odd, n, grp, side = point[order], odd[order], n[order], grp[order], side[order]
    cuts = np.unique(np.concatenate((np.arange(0, len(n), BOX), np.flatnonzero(np.diff(side, prepend=side[0])))))
    ends = np.append(cuts[1:], len(n))
    hi, least, on = np.maximum.reduceat(point, cuts), np.minimum.reduceat(n, cuts), side[cuts]
    none = np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0))]
    for i in range(len(cuts)):
        near = _enough(np.minimum(hi[i], hi[i:]).sum(axis=1, dtype=np.int64), least[i] + least[i:], percent)
        for j in i + np.flatnonzero(near & ((on[i:] != on[i]) if two else True)):
            x, y = slice(cuts[i], ends[i]), slice(cuts[j], ends[j])
            shared = np.minimum(point[x][:, None], point[y][None]).sum(axis=2, dtype=np.int64)
            fine = _enough(shared, n[x][:, None] + n[y][None], percent) & (grp[x][:, None] != grp[y][None])
            p, q = np.nonzero(np.triu(fine, 1) if i == j else fine)
            p, q = cuts[i] + p, cuts[j] + q
            total = n[p] + n[q]
            both = np.minimum(shared[p - cuts[i], q - cuts[j]], _both(odd[p], odd[q], total))
            keep = _enough(both, total, percent)
            found.append((order[p[keep]], order[q[keep]], (both / (total - both).clip(1))[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _tree(percent: int, connect: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit").combine_chunks()
        point, odd = _rows(table["point"]), _odd(table["odd"])
        unit, doc, n, grp, side = (table[c].to_numpy() for c in ("unit", "doc", "n_shingles", "grp", "side"))
        starts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], len(unit)), strict=True):
            x, y, similar = _unit(point[lo:hi], odd[lo:hi], n[lo:hi], grp[lo:hi], side[lo:hi], percent)
            if connect:
                on = connecting(x, y, similar, grp[lo:hi])
                x, y = x[on], y[on]
            a.append(doc[lo:hi][x])
            b.append(doc[lo:hi][y])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def joined_trees(open_: DataFrame, percent: int, connect: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of different groups that may be linked, under the tokens of open_ (key, doc, grp, n, n_shingles, point, odd).

    connect: of each unit of work only the likeliest pairs that connect its groups.
    """
    cols = ["unit", "bin", "doc", "grp", "side", "n_shingles", "point", "odd"]
    small = open_.where(F.col("n") <= LEAF)
    bins = max(1, small.count() // 4096)
    units = small.select(F.col("key").alias("unit"), F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), "doc", "grp", F.lit(0).alias("side"), "n_shingles", "point", "odd")
    large = open_.where(F.col("n") > LEAF)
    if large.limit(1).count():
        # leaves hold one class of sizes, so that only neighbouring classes meet; a large group has leaves of its own
        large = large.withColumn("level", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int"))
        sizes = large.groupBy("key", "level").agg(F.count(F.lit(1)).alias("c"))
        groups = large.groupBy("key", "level", "grp").agg(F.count(F.lit(1)).alias("g"))
        own = F.xxhash64("level", "grp", F.pmod(F.xxhash64("doc"), F.ceil(F.col("g") / LEAF)))
        leaf = F.when(F.col("g") > LEAF, own).otherwise(F.xxhash64("level", F.pmod(F.xxhash64("grp"), F.ceil(F.col("c") / LEAF))))
        points = cut(large.join(sizes, ["key", "level"]).join(groups, ["key", "level", "grp"]).withColumn("leaf", leaf).select("key", "level", "leaf", "doc", "grp", "n_shingles", "point", "odd"))
        boxes = cut(points.groupBy("key", "leaf").applyInArrow(_box, BOX_ROW))
        other = boxes.select("key", F.explode(F.array("level", F.col("level") - 1)).alias("level"), *[F.col(c).alias(f"{c}2") for c in ("leaf", "hi", "least", "most", "g0", "g1")], F.col("level").alias("level2"))
        apart = F.least("g0", "g02") < F.greatest("g1", "g12")
        once = (F.col("level") < F.col("level2")) | (F.col("leaf") <= F.col("leaf2"))
        sized = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
        meet = cut(boxes.join(other, ["key", "level"]).where(apart & once & sized).mapInArrow(_meeting(percent), "key long, leaf long, leaf2 long"))
        sides = meet.select("key", F.xxhash64("key", "leaf", "leaf2").alias("unit"), F.explode(F.when(F.col("leaf") == F.col("leaf2"), F.array(F.struct("leaf", F.lit(0).alias("side")))).otherwise(F.array(F.struct("leaf", F.lit(0).alias("side")), F.struct(F.col("leaf2").alias("leaf"), F.lit(1).alias("side"))))).alias("at"))
        met = points.join(sides.select("key", "unit", "at.leaf", "at.side"), ["key", "leaf"])
        units = units.union(met.select("unit", F.col("unit").alias("bin"), "doc", "grp", "side", "n_shingles", "point", "odd"))
    return units.select(*cols).groupBy("bin").applyInArrow(_tree(percent, connect), "a long, b long").distinct()


def shingle_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); see the module's text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string").alias("text"))
    points = cut(texts.mapInArrow(_points(size, percent, frequent(texts, size)), POINTS))
    some = points.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "s1", "s2"]
    classes = some.groupBy(*same).agg(F.min(F.struct("doc_id", "tag")).alias("m"), F.first("point").alias("point"), F.first("odd").alias("odd"), F.first("wide").alias("wide"))
    classes = cut(classes.select(*same, F.col("m.doc_id").alias("doc_id"), F.col("m.tag").alias("tag"), F.monotonically_increasing_id().alias("doc"), "point", "odd", "wide"))

    # the topmost level: points under their tokens, those of one set once
    rows = points.where("n_shingles > 0").select(F.explode("tokens").alias("key"), "s1").repartition("key").dropDuplicates(["key", "s1"])
    by_key = Window.partitionBy("key")
    member = rows.select("key", F.col("s1").alias("b"), F.min("s1").over(by_key).alias("a"), F.count(F.lit(1)).over(by_key).alias("n"))
    member = cut(member.where("n > 1"))
    sides = [classes.select(F.col("s1").alias(x), F.col("doc").alias(f"d{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("point").alias(f"p{x}"), F.col("odd").alias(f"o{x}")) for x in "ab"]
    stars = member.where("a <> b").select("a", "b").distinct().join(sides[1], "b").join(sides[0], "a")
    stars = stars.select(F.col("da").alias("a"), F.col("db").alias("b"), "na", "nb", "pa", "pb", "oa", "ob")
    likely = cut(stars.mapInArrow(_bounded(percent), "a long, b long, est double"))
    best = likely.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = cut(verified(narrowed(best, classes, percent), texts, classes, size, percent))
    groups = components(links)

    # what is left: likely pairs and tokens with several groups; first what connects them, then all that is still apart
    done = best
    for connect in (True, False):
        ends = [groups.select(F.col("node").alias(x), F.col("component").alias(f"g{x}")) for x in "ab"]
        rest = likely.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ga", "a") != F.coalesce("gb", "b"))
        if connect:
            rest = rest.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        labelled = member.where("n > 2").select("key", F.col("b").alias("s1")).join(classes.select("s1", "doc"), "s1")
        labelled = cut(labelled.join(groups, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("grp")))
        mixed = labelled.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64("doc", F.lit(1)) % (1 << 31)).alias("y"))
        once = mixed.where("lo < hi").groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # tokens over the same points count once
        open_ = cut(labelled.join(once.select("key", "n"), "key").join(classes.select("doc", "n_shingles", "point", "odd"), "doc"))
        more = rest.select("a", "b").union(joined_trees(open_, percent, connect)).distinct()
        more = cut(more.join(done, ["a", "b"], "left_anti"))
        new = cut(verified(narrowed(more, classes, percent), texts, classes, size, percent))
        drop_cut(labelled), drop_cut(open_)
        if new.limit(1).count():
            links = links.union(new)
            groups = components(links)
        done = done.union(more)
    drop_cut(member)

    by_class = cut(classes.join(groups, F.col("doc") == F.col("node"), "left").select(*same, "doc_id", F.coalesce("component", "doc").alias("component")))
    least = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = cut(by_class.join(least, "component").select(*same, "component_id"))
    out = points.select("doc_id", *same)
    return out.join(found, [out["doc_id"].isNotNull(), *[out[c] == found[c] for c in same]], "left").select(out["doc_id"], out["n_shingles"], F.coalesce("component_id", out["doc_id"]).alias("component_id"))
