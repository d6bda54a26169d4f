"""Entity resolution: canonical values, stable placeholders per session, substitution, encrypted mapping.

Mapping: session_id, placeholder, canonical, entity_type, original_forms (distinct, in order), surface_forms (each occurrence, in order).
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions import fixed, text
from veilstream.functions.values import replaced
from veilstream.sources.tables import dealt, settled

#: Types whose values may be matched with small differences. Numbers are not: one digit makes another number.
FUZZY_TYPES = ("PER", "ORG", "LOC", "ADDR")


def canonical(value: Column, kind: Column, language: str = "ru", whole_words: bool = True) -> Column:
    """The value under which mentions are one entity. Organizations lose their legal form (as whole words, or anywhere) and quotes."""
    plain = text.collapse(F.lower(text.strip(value)))
    if language != "ru":
        return plain
    edge = ("(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])") if whole_words else ("", "")
    forms = "(?U)" + edge[0] + "(?:" + "|".join(fixed.LEGAL_FORMS_REMOVED) + ")" + edge[1]
    org = text.collapse(text.strip(F.regexp_replace(F.regexp_replace(plain, forms, ""), "[«»\"'“”]", "")))
    return F.when(kind == "ORG", F.when(org != "", org).otherwise(plain)).otherwise(plain)


def with_lemmas(rows: DataFrame, lemma: Callable[[Column], Column], value: str = "canonical", kind: str = "entity_type") -> DataFrame:
    """rows in which the words of persons' values are replaced by their dictionary forms, so that declined forms of a name are one entity.

    lemma: from a word to its dictionary form, as a column expression (a Pandas UDF, say). Each distinct value is looked up
    once, word by word, however many words it has. A value's rows are dealt into as many shares as Spark shuffles into, each of which
    meets its dictionary form once, so a name that most rows hold is not one task's work.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(*told), F.lit(parts)))
    met = settled(rows.where(F.col(kind) == "PER").select(F.col(value).alias("_v"), "_s").distinct())
    values = met.select("_v").distinct()
    words = values.select("_v", F.posexplode(F.split("_v", " ")).alias("_i", "_w")).withColumn("_l", lemma(F.col("_w")))
    named = words.groupBy("_v").agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("_l")).select("_v", F.array_join(F.col("_l._l"), " ").alias("_l"))
    shares = met.join(dealt(named), "_v").withColumnRenamed("_s", "_t")
    found = rows.join(dealt(shares, "_v", "_t"), (F.col(value) == F.col("_v")) & (F.col("_s") == F.col("_t")) & (F.col(kind) == "PER"), "left")
    return found.withColumn(value, F.coalesce("_l", value)).drop("_v", "_l", "_s", "_t")


def label(kind: Column, language: str = "ru") -> Column:
    """The label of a type's placeholders; other types are their own label."""
    table = F.create_map(*[F.lit(x) for t, ru, en, _, _ in fixed.ENTITY_TYPES for x in (t, ru if language == "ru" else en)])
    return F.coalesce(F.try_element_at(table, kind), kind)


def edit_limit(length: Column) -> Column:
    """Edits that are let pass: one in four characters, four at most."""
    return F.least(F.floor(length / 4), F.lit(4)).cast("int")


def _limit(length: int) -> int:
    return min(length // 4, 4)


def _segments(length: int, most: int) -> list[tuple[int, int]]:
    """(start, size) of the most + 1 segments that a value of this length is cut into."""
    size, longer = divmod(length, most + 1)
    sizes = [size + (i > most - longer) for i in range(most + 1)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _kept_pieces(value: str) -> Iterator[str]:
    """Segments under which a value is found by values that let pass 1, 2, 3 or 4 edits and are of like length."""
    n = len(value)
    for most in range(1, 5):
        if any(_limit(k) == most for k in range(max(0, n - most), n + most + 1)) and n > most:
            for i, (at, size) in enumerate(_segments(n, most)):
                yield f"{most} {n} {i} {value[at : at + size]}"


def _sought_pieces(value: str) -> Iterator[str]:
    """Pieces of a value that equal a segment of each value with at most _limit() edits: of most + 1 segments one has no edit, and
    the edits before and behind it bound how far it is shifted."""
    n, most = len(value), _limit(len(value))
    for other in range(n - most, n + most + 1) if most else ():
        for i, (at, size) in enumerate(_segments(other, most)):
            least, last = max(at - i, at + (n - other) - (most - i), 0), min(at + i, at + (n - other) + (most - i), n - size)
            for k in range(least, last + 1):
                yield f"{most} {other} {i} {value[k : k + size]}"


def _pieces(pieces: Callable[[str], Iterator[str]], n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 1000):
                p = part.slice(lo, 1000)
                found = [list(dict.fromkeys(pieces(v or ""))) for v in p.column(n).to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in p.columns], pa.array([y for x in found for y in x], pa.string())], names=[*p.schema.names, "piece"])

    return run


def close_values(values: DataFrame) -> DataFrame:
    """(session_id, entity_type, at, value, before, head) for values (session_id, entity_type, at, value): the earlier values (by at) of
    the session and type from which at most _limit() edits lead to a value.

    Pairs meet under equal pieces, so work does not grow with the square of a session's values; each pair is verified.
    """
    key = ["session_id", "entity_type"]
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*key, "at", "value")) + ", piece string"
    rows = values.select(*key, "at", "value")
    kept, sought = (rows.mapInArrow(_pieces(f, 3), shape) for f in (_kept_pieces, _sought_pieces))
    pairs = sought.join(dealt(kept.select(*key, "piece", F.col("at").alias("before"), F.col("value").alias("head"))), [*key, "piece"]).where("before < at")
    pairs = pairs.drop("piece").distinct()
    return pairs.where(F.levenshtein("head", "value", 4).between(0, edit_limit(F.char_length("value"))))


def fuzzy_entities(values: DataFrame, fuzzy_types: tuple[str, ...] | None) -> DataFrame:
    """values (session_id, canonical, entity_type, ord) with `entity`: in order, each joins the first earlier entity of its type that is close enough.

    An earlier value that has joined another is no entity, so it is settled in rounds: a value whose first close value is an
    entity joins it, and what has joined is struck out for later values. All values of a chain are settled within its length.
    """
    some = values if fuzzy_types is None else values.where(F.col("entity_type").isin(*fuzzy_types))
    at = F.concat_ws("|", "ord", "entity_type", "canonical")
    left = settled(close_values(some.select("session_id", "entity_type", at.alias("at"), F.col("canonical").alias("value"))).select("session_id", "at", "before", "head"))
    joined = None
    while left.limit(1).count():
        open_ = left.select("session_id", F.col("at").alias("before")).distinct().withColumn("open", F.lit(True))
        first = left.groupBy("session_id", "at").agg(F.min(F.struct("before", "head")).alias("f")).select("session_id", "at", "f.before", "f.head")
        now = settled(first.join(open_, ["session_id", "before"], "left").where("open is null").select("session_id", "at", "head"))
        joined = now if joined is None else joined.union(now)
        gone = now.select("session_id", "at")
        left = settled(left.join(gone, ["session_id", "at"], "left_anti").join(gone.withColumnRenamed("at", "before"), ["session_id", "before"], "left_anti").select("session_id", "at", "before", "head"))
    if joined is None:
        return values.withColumn("entity", F.col("canonical"))
    found = values.withColumn("at", at).join(joined, ["session_id", "at"], "left")
    return found.withColumn("entity", F.coalesce("head", "canonical")).drop("at", "head")


def placeholders(spans: DataFrame, language: str = "ru", numbering: str = "reverse", fuzzy: bool = False, legacy_fuzzy: bool = False, strict_types: bool = False, lemma: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """spans (session_id, doc_id, ...) with `placeholder`, and the mapping.

    Entities are numbered per session and label in the order in which they are first met, from the end of the texts or
    from the start. Types share an entity of equal canonical value unless strict_types. Exact values are resolved by
    grouping; with fuzzy, a session's distinct values (not its mentions) are joined with those that differ little.
    """
    rows = spans.withColumn("canonical", canonical(F.col("text"), F.col("entity_type"), language))
    if lemma is not None and language == "ru":
        rows = with_lemmas(rows, lemma)
    sign = -1 if numbering == "reverse" else 1
    rows = rows.withColumn("ord", F.struct((sign * F.col("doc_id")).alias("d"), (sign * F.col("start")).alias("s")))
    key = ["session_id", "canonical", *(["entity_type"] if strict_types else [])]
    first = rows.groupBy(*key).agg(F.min("ord").alias("ord"), *([] if strict_types else [F.min_by("entity_type", "ord").alias("entity_type")]))
    if fuzzy or legacy_fuzzy:
        shape = first.select("session_id", "canonical", "entity_type", F.concat_ws(",", F.format_string("%020d", F.col("ord.d") + 2**62), F.format_string("%020d", F.col("ord.s") + 2**62)).alias("ord"))
        entity = fuzzy_entities(shape, None if legacy_fuzzy else FUZZY_TYPES)
    else:
        entity = first.withColumn("entity", F.col("canonical"))
    entity = entity.withColumn("label", label(F.col("entity_type"), language))
    heads = entity.where("entity = canonical").withColumn("number", F.row_number().over(Window.partitionBy("session_id", "label").orderBy("ord")))
    heads = heads.select("session_id", F.col("canonical").alias("entity"), F.col("entity_type").alias("head_type"), F.concat(F.lit("["), "label", F.lit("_"), "number", F.lit("]")).alias("placeholder"))
    on = ["session_id", "entity"]
    if strict_types:
        heads, on = heads.withColumnRenamed("head_type", "entity_type"), [*on, "entity_type"]
        heads = heads.withColumn("head_type", F.col("entity_type"))
    named = entity.drop("ord", "label").join(dealt(heads), on) if fuzzy or legacy_fuzzy else heads.withColumn("canonical", F.col("entity"))
    named = named.select(*key, "placeholder", F.col("entity").alias("_entity"), "head_type")
    given = dealt(rows, *key).join(named, key)  # mentions of a text put together from columns are few bytes when they are shuffled, and many when they are sorted
    found = given.groupBy("session_id", "placeholder").agg(
        F.min("_entity").alias("canonical"), F.min("head_type").alias("entity_type"), F.array_sort(F.collect_list(F.struct("doc_id", "start", "text"))).alias("m"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("o")
    )
    mapping = found.select("session_id", "placeholder", "canonical", "entity_type", F.array_distinct(F.col("o.text")).alias("original_forms"), F.col("m.text").alias("surface_forms"))
    return given.select(*spans.columns, "canonical", "placeholder"), mapping


def substitute(docs: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its placeholder; spans must not overlap. Texts without spans stay."""
    lists = given.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("s"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
    rows = texts.join(dealt(lists), "doc_id", "left")
    at = lambda i: F.coalesce(F.get("s", i - 1)["end"], F.lit(0))
    pieces = F.transform("s", lambda x, i: F.concat(F.substring("body", at(i) + 1, x["start"] - at(i)), x["placeholder"]))
    out = F.concat(F.array_join(pieces, ""), F.substring("body", F.element_at("s", -1)["end"] + 1, F.char_length("body")))
    return rows.select("doc_id", F.when(F.size("s") > 0, out).otherwise(F.col("body")).alias("text"))


#: Characters, and texts, of a batch that leaves the pass over texts and values.
CHARACTERS_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 1000


def _by_value(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of rows (doc_id, of, old, new) in order of doc_id and of: first a document's texts as `old`, then its values in turn."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = zip(*out, strict=True)
        done = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(done, names=["doc_id", "text", "applied", "skipped"])

    rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
    size = 0
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        bodies, pairs = [], []
        for _, of, old, new in group:
            if of is None:
                bodies.append(old)
            elif key is not None and bodies and pairs[-1:] != [(old, new)]:
                pairs.append((old, new))
        for body in bodies:
            done, applied = (body, 0) if body is None else replaced(body, pairs)
            out.append((key, done, applied, len(pairs) - applied))
            size += len(done or "")
            if size >= CHARACTERS_AT_ONCE or len(out) >= TEXTS_AT_ONCE:
                yield batch()
                size = 0
    if out:
        yield batch()


def substitute_by_value(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, text, applied, skipped): each old value of values (doc_id, old, new) by the new one wherever it stands, longest first.

    All values of a text are found in one pass over it. Values that stand nowhere are counted as skipped; those that are
    null or empty, or have no new value, are left out. Texts and values are sorted as rows, so Spark holds no list of a text's values.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none, key = F.lit(None), F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(key, none.cast("int").alias("of"), F.col("text").alias("old"), none.cast("string").alias("new"))
    given = values.where("old <> '' and new is not null").select(key, (-F.char_length("old")).alias("of"), "old", "new")
    rows = texts.union(given).repartition(parts, "doc_id").sortWithinPartitions("doc_id", F.col("of").asc_nulls_first(), "old", "new")
    return rows.mapInArrow(_by_value, "doc_id long, text string, applied int, skipped int")


def entries(mapping: DataFrame) -> DataFrame:
    """(session_id, form, placeholder, canonical, entity_type): a row for each form that leads to a placeholder."""
    return mapping.select("session_id", F.explode(F.array_distinct(F.concat(F.array("canonical"), "original_forms"))).alias("form"), "placeholder", "canonical", "entity_type")


def entity_counts(mapping: DataFrame) -> DataFrame:
    """(session_id, entity_count): distinct placeholders of each session."""
    return mapping.groupBy("session_id").agg(F.count_distinct("placeholder").alias("entity_count"))


def restore_text(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(session_id, doc_id, text) with undistorted placeholders replaced by the first original form, else the canonical value."""
    table = mapping.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", F.coalesce(F.get("original_forms", F.lit(0)), "canonical")))).alias("m"))
    pieces = F.regexp_extract_all("text", F.lit(r"(\[[^\[\]]*\]|[^\[]+|\[)"), 1)
    out = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("m", p), p)), "")
    return texts.join(dealt(table), "session_id", "left").select("session_id", "doc_id", F.when(F.col("m").isNotNull(), out).otherwise(F.col("text")).alias("text"))


def surface_forms(occurrences: DataFrame) -> DataFrame:
    """(session_id, placeholder, surface_forms): forms in order of (doc_id, start), rebuilt as a whole."""
    got = occurrences.groupBy("session_id", "placeholder").agg(F.array_sort(F.collect_list(F.struct("doc_id", "start", "text"))).alias("m"))
    return got.select("session_id", "placeholder", F.col("m.text").alias("surface_forms"))


def correct(mapping: DataFrame, fixes: DataFrame) -> DataFrame:
    """mapping with canonical values from fixes (session_id, placeholder, value); their forms start anew."""
    rows = mapping.join(fixes.select("session_id", "placeholder", F.col("value").alias("_v")), ["session_id", "placeholder"], "left")
    changed = F.col("_v").isNotNull()
    return rows.select("session_id", "placeholder", F.coalesce("_v", "canonical").alias("canonical"), "entity_type", F.when(changed, F.array("_v")).otherwise(F.col("original_forms")).alias("original_forms"), F.when(changed, F.array().cast("array<string>")).otherwise(F.col("surface_forms")).alias("surface_forms"))


def _key(master: bytes, session: Column) -> Column:
    """A key for each session: HKDF with SHA-256 whose info is the session. Only the master key enters on the driver."""
    prk = hmac.new(b"\0" * 32, master, hashlib.sha256).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in prk)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, session.cast("binary"), F.lit(b"\x01")), 256))
    return F.unhex(F.sha2(F.concat(outer, once), 256))


def seal(mapping: DataFrame, master: bytes) -> DataFrame:
    """(session_id, sealed): each session's mapping as AES-GCM bytes, nonce first, under a key of the session's own."""
    rows = mapping.groupBy("session_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("placeholder", "canonical", "entity_type", "original_forms", "surface_forms")))).alias("j"))
    return rows.select("session_id", F.aes_encrypt("j", _key(master, F.col("session_id").cast("string")), F.lit("GCM")).alias("sealed"))


def unseal(sealed: DataFrame, master: bytes) -> DataFrame:
    """The mapping; sessions that the key does not open are left out."""
    shape = "array<struct<placeholder:string,canonical:string,entity_type:string,original_forms:array<string>,surface_forms:array<string>>>"
    rows = sealed.withColumn("j", F.try_aes_decrypt("sealed", _key(master, F.col("session_id").cast("string")), F.lit("GCM")).cast("string")).where("j is not null")
    return rows.select("session_id", F.inline(F.from_json("j", shape)))
