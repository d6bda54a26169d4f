"""Document fingerprints by I-Match, in SQL functions only.

The lexicon holds the terms whose share of documents lies in a band of inverse document frequency. A document's terms
in the lexicon, distinct and sorted by their hashes, are hashed as a whole and once for each of several randomised
subsets of the lexicon; the hashes together are its fingerprint. Subsets keep from a quarter down to a 256th of the terms, so
that texts of any length have some that hold a few of their terms: two texts are as alike as the share of non-empty
subsets whose hashes agree. A subset is drawn by one byte of a term's hash; those of one byte lie inside each other.

A term in the lexicon is in at least SHARES[0] of all documents, so the lexicon has no more than (mean number of
distinct terms of a document) / SHARES[0] terms, however many documents there are; it is handed to the tasks as a
literal table. Counts are over all documents.

Edge cases: null text is empty; a text without terms of the band is hashed from all of its terms; equal texts have
equal fingerprints and likeness 1; documents of equal id follow each other in a fixed order; null ids come after all
others; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.common import SPACE

#: The band: least and greatest share of documents that a term of the lexicon is in.
SHARES = (1 / 1000, 1 / 5)
#: Of 256, how many terms the subsets keep that are drawn by the first, second, … byte of a term's hash.
KEEPS = ((64, 8, 4, 2), (32, 8, 4, 2, 1), (16, 8, 4, 2, 1), (16, 4, 2, 1), (4, 2, 1), (4, 2, 1))
#: Buckets of the lexicon's table, a power of two.
TABLE = 1 << 14
#: Neighbouring documents that one task looks at together.
TOGETHER = 2000


def terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), SPACE)), lambda t: t != "")


def lexicon(docs: DataFrame) -> list[str]:
    """The terms of the band; their number is bounded, see above."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [r["term"] for r in df.where((F.col("n") >= SHARES[0] * n) & (F.col("n") <= SHARES[1] * n)).select("term", F.pmod(F.xxhash64("term"), F.lit(TABLE)).alias("b")).orderBy("b", "term").collect()]


def _table(docs: DataFrame, words: list[str]) -> Column:
    """Literal array: at a term's hash the terms with that hash, each between blanks."""
    rows = [""] * TABLE
    if words:
        at = docs.sparkSession.createDataFrame([(w,) for w in words], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(TABLE)).alias("b")).collect()
        for r in at:
            rows[r["b"]] += f" {r['term']} "
    return F.split(F.lit("\n".join(rows)), "\n")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _hashed(terms_: Column) -> Column:
    return F.array(F.when(F.size(terms_) > 0, F.xxhash64(terms_)))


def _subsets(terms_: Column, place: int, keeps: tuple[int, ...]) -> Column:
    """Hashes of the subsets drawn by a byte, each from the one before."""
    if not keeps:
        return _hashed(terms_)
    low = F.filter(terms_, lambda h: F.shiftrightunsigned(h, 8 * place).bitwiseAND(F.lit(255)) < keeps[0])
    if len(keeps) == 1:
        return _let(low, _hashed)
    return _let(low, lambda s: F.concat(_hashed(s), _subsets(s, place, keeps[1:])))


def fingerprint(text: Column, table: Column) -> Column:
    """Array of hashes, of all terms in the lexicon and of each subset; null where there are none."""
    known = F.filter(terms(text), lambda t: F.contains(F.get(table, F.pmod(F.xxhash64(t), F.lit(TABLE)).cast("int")), F.concat(F.lit(" "), t, F.lit(" "))))
    hashes = F.sort_array(F.transform(known, lambda t: F.xxhash64(t)))
    return _let(hashes, lambda k: F.concat(_hashed(k), *[_subsets(k, place, keeps) for place, keeps in enumerate(KEEPS)]))


def whole(text: Column, print_: Column) -> Column:
    """A hash of all terms, for texts that have none in the lexicon."""
    return F.when(print_[0].isNull(), F.xxhash64(F.lit("whole"), F.sort_array(terms(text))))


def likeness(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """Share of the subsets with terms in either text whose hashes agree; without any, whether all terms do."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    some = F.aggregate(F.zip_with(a, b, lambda x, y: (x.isNotNull() | y.isNotNull()).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(some > 0, same / some).otherwise((wa == wb).cast("double"))


def as_string(a: Column, w: Column) -> Column:
    hashes = F.array_join(F.transform(a, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit(""))), "-")
    return F.when(F.exists(a, lambda x: x.isNotNull()), hashes).otherwise(F.concat(F.lit("w"), F.lower(F.hex(w))))


def _bounds(docs: DataFrame, n: int) -> tuple[Column, int]:
    """Literal array of n - 1 ids that divide the documents evenly (n a power of two), filled up to n."""
    got = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n).alias("p")).first()["p"] or []
    values = sorted(got) + [2**63 - 1] * (n - len(got))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), n


def _bucket(id_: Column, bounds: Column, n: int) -> Column:
    """Number of bounds that are at most id_, by halving."""
    steps = F.array(*[F.lit(n >> (k + 1)) for k in range(n.bit_length() - 1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= id_, step).otherwise(0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text)."""
    given = F.col("doc_id").cast("long")
    texts = docs.select(given.alias("doc_id"), F.coalesce(given, F.lit(-(2**63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = _table(docs, lexicon(texts))
    n = texts.count()
    size = 64
    while size * TOGETHER < n and size < 1 << 15:
        size *= 2
    bounds, size = _bounds(texts, size)
    # rows without an id, however many, come after all others by the hash of their texts, in buckets of their own
    nameless = F.shiftright("h", 64 - size.bit_length() + 1).cast("int") - size
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("bucket", F.when(F.col("doc_id").isNull(), nameless).otherwise(_bucket(F.col("id"), bounds, size)))
    # a bucket's last document is followed by the first of the next bucket below that has any; after the last, by the first of all
    tops = texts.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top"))  # one row for each bucket
    up = Window.partitionBy(F.lit(0)).orderBy("bucket")
    all_ = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.coalesce(F.lead("bucket").over(up), F.first("bucket").over(all_)).alias("to"), F.col("top.id").alias("id"), F.col("top.h").alias("h"))
    with_print = lambda df: df.withColumn("f", fingerprint(F.col("text"), table)).withColumn("w", whole(F.col("text"), F.col("f")))
    own = with_print(texts.select("doc_id", "id", "text", "h", "bucket", F.lit(0).alias("guest")))
    guests = with_print(texts.drop("bucket").join(F.broadcast(tops), ["id", "h"]).select("doc_id", "id", "text", "h", F.col("to").alias("bucket"), F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc(), F.col("h").desc())
    pairs = own.union(guests).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "f", "w")}).where("guest = 0")
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    out = pairs.select("doc_id", chars.cast("long").alias("n_chars"), edited.alias("edited"), "f", "w", "next_f", "next_w")
    out = out.withColumn("ef", fingerprint(F.col("edited"), table)).withColumn("ew", whole(F.col("edited"), F.col("ef")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("f"), F.col("w")).alias("fingerprint"), as_string(F.col("ef"), F.col("ew")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef"), F.col("w"), F.col("ew")).alias("near_edited"), likeness(F.col("f"), F.col("next_f"), F.col("w"), F.col("next_w")).alias("near_next"),
    )
