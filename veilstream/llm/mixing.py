"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule w(t) = target * (1 + slope * (2t - 1)) for t from 0 to 1, whose integral is the
source's target. A source's documents stand in a random but fixed order and are passed over again and again until the
target is reached; the word at which a copy starts, inverted through the cumulative demand, is its training position
t. The mix is range-sorted by position. The copy in which a source's target is reached is cut there, so that a source's
words are its target to the word; with `miss` it is taken whole or not at all, whichever is nearer, unless both would
miss the target by more than that share of it.

Edge cases: null or blank text has size 0 and is never taken; the null source is a source, ordered last; an empty
table gives no rows; repeated rows are documents of their own; null doc_ids are documents like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.common import SPACE, cut, numbered, unused

WEIGHTS = (5, 2, 1)
#: Slopes of the schedules of sources with these weights: heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
#: No source or document is taken more often than this.
MOST = 3
#: Share of its target that a source may miss in `mixed`, so that its last copy stays whole.
MISS = 0.01


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `target` and `slope` to sizes (source, source_size).

    All words are shared by weight; no source gets more than `most` times its size, what is over goes to the others by
    weight. That is a common level: each target is the smaller of limit and weight * level. The table has a row for
    each source, never for each document; it is sorted in one task, so there should be no more than some ten million sources.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (nth + 1).cast("int"))
    rows = sizes.select("source", "source_size", pick(WEIGHTS).cast("double").alias("w"), pick(SLOPES).alias("slope"), (most * F.col("source_size")).cast("double").alias("most"))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_ = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(all_).cast("double")).withColumn("level", (F.col("total") - before) / rest)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct((F.col("most") / F.col("w")).alias("at"), "level"))
    rows = rows.withColumn("level", F.coalesce(F.min(fits).over(all_)["level"], F.lit(float("inf"))))
    return rows.select("source", "source_size", "slope", F.least("most", F.col("w") * F.col("level")).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The t at which a source has supplied this share of its target: t + slope * (t*t - t) = share."""
    one = 1 - slope
    root = F.sqrt(one * one + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(F.abs((root - one) / (2 * slope)))  # no -0.0, which sorts apart from 0.0


def _plan(docs: DataFrame, miss: float) -> DataFrame:
    """A row for each of docs (row, doc_id, text, source): what the mix takes of it. row tells rows apart."""
    text = F.col("text").cast("string")
    rows = cut(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col("source").cast("string").alias("source"), n_words(text).alias("size")))
    shares = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    rows = numbered(rows, ["source"], [F.col("doc_id"), F.col("h"), F.col("size")], "at", max(64, rows.count() // 50_000), F.col("size"), ("row",))
    rows = rows.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quota = F.round("target").cast("long")
    size = F.col("size")

    def words(start: Column) -> Column:
        """Words taken of the copy that starts here."""
        left = quota - start
        whole = F.when(2 * left >= size, size).otherwise(F.lit(0))
        missed = F.when(2 * left >= size, size - left).otherwise(left)
        return F.when(left >= size, size).otherwise(F.when(missed <= miss * F.col("target"), whole).otherwise(left))

    starts = F.transform(F.array(*[F.lit(i) for i in range(MOST)]), lambda i: i * F.col("source_size") + F.col("at"))
    starts = F.filter(starts, lambda x: (x < quota) & (size > 0))
    copies = F.filter(F.transform(starts, lambda x: F.struct(position(x / F.col("target"), F.col("slope")).alias("at"), words(x).alias("words"))), lambda c: c["words"] > 0)
    return rows.select("row", "doc_id", "h", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, miss: float = 0.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions) for each row of docs (doc_id, text, source), by first position.

    positions holds the training position of each copy that the mix takes; a document that is not taken comes last.
    """
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken")
    plan = _plan(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"), miss)
    out = plan.select("doc_id", "h", "source", "size", "source_size", "target", taken, F.col("copies.at").alias("positions"))
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id", "h").drop("h")


def mixed(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """The documents as the mix takes them, a row for each copy, by position; a copy that is cut keeps its first words.

    Columns are those of docs; each row of docs is a document of its own, whatever others it equals.
    """
    row, at, words, size = unused(docs.columns, "row", "at", "words", "size")
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # each row's number is given once
    plan = _plan(held.select(F.col(row).alias("row"), "doc_id", "text", "source"), miss)
    copies = plan.select(F.col("row").alias(row), F.col("size").alias(size), F.explode("copies").alias("c")).select(row, size, F.col("c.at").alias(at), F.col("c.words").alias(words))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leading = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    short = F.array_join(F.slice(pieces, F.lit(1), (F.col(words) + leading).cast("int")), "")
    text = F.when(F.col(words) < F.col(size), short).otherwise(F.col("text"))
    return held.join(copies, row).withColumn("text", text).orderBy(at, row).select(*docs.columns)
