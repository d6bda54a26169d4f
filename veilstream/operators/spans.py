"""Span algebra: merging, overlaps, joins of span sets, offsets across substitutions.

Spans of one document are compared through windows over the document or through joins on (document, bin of BIN
characters), never as all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions import fixed, values
from veilstream.operators.policy import aliases
from veilstream.sources.tables import dealt, unlisted

BIN = 256
#: Spans of a batch that leaves an Arrow pass.
SPANS_AT_ONCE = 4000
KEY = ("doc_id", "start", "end", "entity_type", "text")


def priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for t, _, _, p, _ in fixed.ENTITY_TYPES for x in (t, p)])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def merge_adjacent_persons(spans: DataFrame) -> DataFrame:
    """Persons that follow each other within a few blanks or signs become one. Needs `tail`: the characters behind each span."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", F.desc("score"), "entity_type")
    prev = lambda c: F.lag(c).over(order)
    gap = F.col("start") - prev("end")
    between = F.substring(prev("tail"), F.lit(1), gap)
    linked = (F.col("entity_type") == "PER") & (prev("entity_type") == "PER") & gap.between(0, fixed.PERSON_GAP) & between.rlike(r"\A[ \t,.\-]*\z")
    rows = spans.withColumn("_link", F.coalesce(linked, F.lit(False))).withColumn("_piece", F.when(F.col("_link"), F.concat(between, "text")).otherwise(F.col("text"))).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_group", F.sum(F.when(F.col("_link"), 0).otherwise(1)).over(order))
    rest = [c for c in spans.columns if c not in ("doc_id", "start", "end", "text", "score", "tail")]
    out = rows.groupBy("doc_id", "_group").agg(
        F.min("start").alias("start"),
        F.max_by("end", "_n").alias("end"),
        F.max_by("tail", "_n").alias("tail"),
        F.max("score").alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_piece"))), lambda x: x["_piece"]), "").alias("text"),
        *[F.min_by(c, "_n").alias(c) for c in rest],
    )
    return out.select(*spans.columns)


def _replaces(old: Column, new: Column) -> Column:
    """Type rank, then a score of 0.9 and more, then score, then length; ties keep the old one."""
    rank = lambda s: F.struct(s["priority"], (s["score"] >= 0.9).cast("int").alias("high"), s["score"].alias("score"), (s["end"] - s["start"]).alias("length"))
    return rank(new) > rank(old)


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Spans that do not overlap: from the left, each span is held against the last one kept.

    Spans that begin behind all earlier ends start an island; islands are resolved each by itself.
    """
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("score"), F.desc("end"), "entity_type")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col("start") >= F.coalesce(earlier, F.lit(0)), 1).otherwise(0)).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_island", F.sum("_new").over(order))
    others = [c for c in spans.columns if c not in ("doc_id", "start", "end", "score")]
    item = F.struct("_n", "start", "end", "score", priority(F.col("entity_type")).alias("priority"), *others)
    islands = rows.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(item)).alias("s"))
    first = F.slice("s", 1, 1)

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        replaced = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        return F.when(s["start"] >= last["end"], F.concat(kept, F.array(s))).when(_replaces(last, s), replaced).otherwise(kept)

    kept = F.aggregate(F.slice("s", F.lit(2), F.size("s")), first, step)
    return islands.select("doc_id", F.explode(kept).alias("k")).select(*[c if c == "doc_id" else F.col(f"k.{c}").alias(c) for c in spans.columns])


def add_aliases(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with the other occurrences of accepted organizations' short names, where no span is yet.

    All names of a document are looked for in one pass over its text; only documents with names are looked at. Among
    occurrences that overlap the leftmost, longest stays.
    """
    names = aliases(spans).withColumnRenamed("alias", "text")
    hits = _located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), names, values.whole, fixed.PERSON_GAP)
    new = hits.select("doc_id", "text", F.lit("ORG").alias("entity_type"), "start", "end", F.least("score", F.lit(0.88)).alias("score"), "source_layer", "recognizer", "tail", "derived_from")
    new = overlap_anti(new, spans)
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    free = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = new.withColumn("_free", F.col("start") >= free).where("_free").drop("_free")
    return spans.unionByName(new, allowMissingColumns=True)


def _bins(start: Column, end: Column) -> Column:
    last = F.greatest(end - 1, start)
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(last / BIN)))


def _conflicts(left: DataFrame, right: DataFrame, test) -> DataFrame:
    """doc_id, start, end of left spans for which test(left, right) holds with some right span of the document."""
    a = left.select("doc_id", "start", "end").distinct().withColumn("bin", _bins(F.col("start"), F.col("end")))
    b = right.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), _bins(F.col("start"), F.col("end")).alias("b")).distinct()
    on = (F.col("doc_id") == F.col("d")) & (F.col("bin") == F.col("b")) & test
    return a.join(dealt(b), on, "left_semi").select("doc_id", "start", "end").distinct()


def overlaps() -> Column:
    return (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))


def overlap_anti(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(dealt(_conflicts(left, right, overlaps())), ["doc_id", "start", "end"], "left_anti").select(*left.columns)


def carry_state(spans: DataFrame, previous: DataFrame) -> DataFrame:
    """spans with id, placeholder, state and user_added of equal spans of an earlier run; new ones are pending."""
    fresh = F.concat_ws("-", "doc_id", "entity_type", "start", "end")
    old = previous.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("id", "placeholder", "state", "user_added")]).dropDuplicates(list(KEY))
    out = spans.join(dealt(old), list(KEY), "left")
    return out.select(*spans.columns, F.coalesce("_id", fresh).alias("id"), F.col("_placeholder").alias("placeholder"), F.coalesce("_state", F.lit("pending")).alias("state"), F.coalesce("_user_added", F.lit(False)).alias("user_added"))


def suggestions(current: DataFrame, found: DataFrame) -> DataFrame:
    """Found spans that are neither in current nor overlap one of it."""
    return overlap_anti(found.join(dealt(current.select(*KEY)), list(KEY), "left_anti"), current)


def removals(current: DataFrame, found: DataFrame) -> DataFrame:
    """Current spans, other than rejected ones, that were not found again."""
    return current.where(F.coalesce("state", F.lit("")) != "rejected").join(dealt(found.select(*KEY)), list(KEY), "left_anti").select(*current.columns)


def add_user_spans(spans: DataFrame, added: DataFrame) -> DataFrame:
    """spans and the user's own; a user's span evicts those inside it."""
    inside = (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))
    kept = spans.join(dealt(_conflicts(spans, added, inside)), ["doc_id", "start", "end"], "left_anti").select(*spans.columns)
    return kept.unionByName(added, allowMissingColumns=True)


def apply_review(base: DataFrame, accepted_removals: DataFrame, accepted: DataFrame) -> DataFrame:
    """base without accepted removals, with accepted suggestions that it does not have, in order."""
    kept = base.join(dealt(accepted_removals.select(*KEY)), list(KEY), "left_anti")
    new = accepted.join(dealt(base.select(*KEY)), list(KEY), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).orderBy("doc_id", "start", "end").select(*base.columns)


def _placed(spans: DataFrame, docs: DataFrame, place) -> DataFrame:
    """spans moved to place(body, text, start, end), a start and end, or dropped where that is None. A text is brought to all of its spans at once."""
    names = [c for c in spans.columns if c != "doc_id"]
    groups = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("s"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("body"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            given, owners = unlisted(part.column(2))
            last, body = -1, ""
            for lo in range(0, given.num_rows, SPANS_AT_ONCE):
                rows, own, at = given.slice(lo, SPANS_AT_ONCE), owners[lo : lo + SPANS_AT_ONCE], []
                for i, *cells in zip(own, *(rows[c].to_pylist() for c in ("text", "start", "end")), strict=True):
                    if i != last:
                        last, body = i, part.column(1)[i].as_py() or ""
                    at.append(place(body, *cells) if None not in cells else None)
                moved = {c: pa.array([a[k] if a else None for a in at], pa.int32()) for k, c in enumerate(("start", "end"))}
                head = part.column(0).take(pa.array(own, pa.int64()))
                out = pa.RecordBatch.from_arrays([head, *[moved.get(n, rows[n]) for n in names]], names=["doc_id", *names])
                yield out.filter(pa.array([a is not None for a in at]))

    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    shape = ", ".join(f"`{n}` {'int' if n in ('start', 'end') else kinds[n]}" for n in ("doc_id", *names))
    return groups.join(dealt(texts, "doc_id"), "doc_id").select("doc_id", "body", "s").mapInArrow(run, shape).select(*spans.columns)


def _found(body: str, value: str, start: int, end: int) -> tuple[int, int] | None:
    at = start if 0 <= start and body[start:end] == value else body.find(value)
    return (at, at + len(value)) if value and at >= 0 else None


def realign(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """A model's spans put where their text is: at their offsets, else at its first occurrence; else they are dropped."""
    return _placed(spans, docs, _found)


def refit(spans: DataFrame, docs: DataFrame, reach: int = 24) -> DataFrame:
    """Spans moved to the only occurrence of their text within `reach` characters; where there is none or several they stay."""

    def near(body: str, value: str, start: int, end: int) -> tuple[int, int]:
        low = max(0, start - reach)
        window = body[low : end + reach]
        at = low + window.find(value) if value and window.count(value) == 1 else start
        return at, at + end - start

    return _placed(spans, docs, near)


def claims(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, start, end, …) where values wanted (doc_id, text, …) stand in texts (doc_id, text): longest first, each place once.

    A value's occurrences follow each other without overlap; one that overlaps a place claimed before is left out. All
    values of a text are found in one pass over it.
    """
    return _located(texts, wanted, values.claimed)


def _located(texts: DataFrame, wanted: DataFrame, find: Callable[[str, list[str]], list[tuple[int, int]]], tail: int | None = None) -> DataFrame:
    """wanted with start and end for each place that find gives, text as it stands there, and `tail` characters behind it.

    A text is brought to all of its values at once.
    """
    names = [c for c in wanted.columns if c not in ("doc_id", "start", "end")]
    groups = wanted.where("text <> ''").groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("s"))
    at = names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, owners = unlisted(part.column(2))
            sought, hits, lo = rows.column(at).to_pylist(), [], 0

            def batch() -> pa.RecordBatch:
                own, which, text, start, end, behind = zip(*hits, strict=True) if hits else ((),) * 6
                cols = dict(zip(names, rows.take(pa.array(which, pa.int64())).columns, strict=True))
                cols |= {"text": pa.array(text, pa.string()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())}
                if tail is not None:
                    cols["tail"] = pa.array(behind, pa.string())
                hits.clear()
                return pa.RecordBatch.from_pydict({"doc_id": part.column(0).take(pa.array(own, pa.int64())), **cols})

            for i, group in itertools.groupby(owners):
                hi = lo + sum(1 for _ in group)
                body, mine = part.column(1)[i].as_py() or "", sought[lo:hi]
                for k, p in find(body, mine):
                    q = p + len(mine[k])
                    hits.append((i, lo + k, body[p:q], p, q, body[q : q + (tail or 0)]))
                    if len(hits) >= SPANS_AT_ONCE:
                        yield batch()
                lo = hi
            if hits:
                yield batch()

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    shape = ", ".join(f"`{n}` {kinds[n]}" for n in ("doc_id", *names)) + ", start int, end int" + (", tail string" if tail is not None else "")
    return groups.join(dealt(texts.select("doc_id", F.col("text").alias("body")), "doc_id"), "doc_id").select("doc_id", "body", "s").mapInArrow(run, shape)


def offsets_before(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points (doc_id, right_start, right_end) in the substituted text, as left_start and left_end in the source; null where they touch a placeholder.

    spans: doc_id, start, end, placeholder, without overlaps.
    """
    order = Window.partitionBy("doc_id").orderBy("start")
    grown = F.char_length("placeholder") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(grown).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = spans.select("doc_id", "start", "end", (F.col("start") + before).alias("_rs"), (F.col("start") + before + F.char_length("placeholder")).alias("_re"), (before + grown).alias("_shift"))
    # both kinds of rows in one order: a point takes the shift of the last placeholder that ends at or before it
    at = moved.select("doc_id", F.col("_re").alias("_at"), F.lit(0).alias("_kind"), "_shift", F.col("_rs").alias("_from"), F.col("_re").alias("_to"), F.lit(None).cast("int").alias("right_start"), F.lit(None).cast("int").alias("right_end"))
    starts = moved.select("doc_id", F.col("_rs").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_shift"), F.col("_rs").alias("_from"), F.col("_re").alias("_to"), F.lit(None).cast("int").alias("right_start"), F.lit(None).cast("int").alias("right_end"))
    asked = points.select("doc_id", F.col("right_start").alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_shift"), F.lit(None).cast("long").alias("_from"), F.lit(None).cast("long").alias("_to"), "right_start", "right_end")
    line = Window.partitionBy("doc_id").orderBy("_at", "_kind")
    past = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    rows = at.unionByName(starts).unionByName(asked)
    rows = rows.withColumns({"_s": F.coalesce(F.last("_shift", ignorenulls=True).over(past), F.lit(0)), "_open": F.last(F.when(F.col("_kind") == 1, F.col("_to")), ignorenulls=True).over(past), "_next": F.first(F.when(F.col("_kind") == 1, F.col("_from")), ignorenulls=True).over(after)})
    rows = rows.where("_kind = 2")
    touches = (F.coalesce("_open", F.lit(-1)) > F.col("right_start")) | (F.coalesce("_next", F.lit(2**31)) < F.col("right_end"))
    return rows.select("doc_id", "right_start", "right_end", F.when(~touches, F.col("right_start") - F.col("_s")).cast("int").alias("left_start"), F.when(~touches, F.col("right_end") - F.col("_s")).cast("int").alias("left_end"))


def resolve_offsets(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, at, seg, local): the piece of a text in which each point (doc_id, at) lies, and its place there.

    pieces (doc_id, seg, text) make up the text in the order of seg. A point between two pieces is at the start of the
    later one; one at the end of the text is at the end of the last, and one beyond it in none. Empty pieces hold no points.
    """
    order = Window.partitionBy("doc_id").orderBy("seg")
    n = F.char_length(F.coalesce("text", F.lit("")))
    end = F.sum(n).over(order)
    starts = pieces.select("doc_id", F.col("seg").alias("_seg"), (end - n).alias("_at"), end.alias("_end"), F.max("seg").over(Window.partitionBy("doc_id")).alias("_last")).where("_end > _at")
    line = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.select("doc_id", "_at", F.lit(0).alias("_kind"), F.struct("_seg", "_at", "_end").alias("_s")).unionByName(points.select("doc_id", F.col("at").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_s")))
    rows = both.withColumn("_s", F.last("_s", ignorenulls=True).over(line)).where("_kind = 1")
    inside = F.col("_at") <= F.col("_s._end")
    return rows.select("doc_id", F.col("_at").alias("at"), F.when(inside, F.col("_s._seg")).alias("seg"), F.when(inside, F.col("_at") - F.col("_s._at")).alias("local"))


def segments(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, i, start, end, text, entity_type): the texts cut into plain and marked pieces; spans that begin before the cursor are skipped."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    shown = resolve_first(spans)
    prev = F.coalesce(F.lag("end").over(order), F.lit(0))
    plain = shown.select("doc_id", prev.alias("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("entity_type"))
    last = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_body"))
    tail = last.join(dealt(shown.groupBy("doc_id").agg(F.max("end").alias("_e"))), "doc_id", "left").select("doc_id", F.coalesce("_e", F.lit(0)).alias("start"), F.char_length("_body").alias("end"), F.lit(None).cast("string").alias("entity_type"))
    pieces = plain.union(tail).union(shown.select("doc_id", "start", "end", "entity_type")).where("start < end")
    pieces = pieces.join(dealt(last), "doc_id").withColumn("text", F.substring("_body", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_body")
    return pieces.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1)


def resolve_first(spans: DataFrame) -> DataFrame:
    """Spans from the left, each that begins at or behind the end of the last one taken.

    Inside an island (see resolve_overlaps) they are taken one after another.
    """
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col("start") >= F.coalesce(earlier, F.lit(0)), 1).otherwise(0)).withColumn("_n", F.row_number().over(order)).withColumn("_island", F.sum("_new").over(order))
    item = F.struct("_n", *[c for c in spans.columns if c != "doc_id"])
    taken = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.slice("s", 1, 1), lambda k, s: F.when(s["start"] >= F.element_at(k, -1)["end"], F.concat(k, F.array(s))).otherwise(k))
    islands = rows.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return islands.select("doc_id", F.explode(taken).alias("k")).select(*[c if c == "doc_id" else F.col(f"k.{c}").alias(c) for c in spans.columns])
