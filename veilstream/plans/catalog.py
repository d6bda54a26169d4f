"""The registered queries over the test tables, each with the SQL it is held against where SQL can say it.

Identifiers with check digits, spans, requests and mappings are derived from whole tables by fixed rules.
"""

from __future__ import annotations

import datetime as dt
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.functions import checksums, fixed
from veilstream.operators import analytics, audit, chunks, diff, evaluate, filters, models, pipeline, policy, recognize, registry, restore, spans, stores
from veilstream.plans import details, golden, growth
from veilstream.plans.registered import oracle_sql, queries, query, read
from veilstream.sources import documents as sources
from veilstream.sources.tables import dealt, settled

__all__ = ["details", "growth", "oracle_sql", "queries"]

EMAIL, PHONE, IP = (r.pattern for r in recognize.LATIN)


def latin_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.resolve_overlaps(recognize.extract_spans(read(spark, sf_dir, "documents"), recognize.LATIN))


@query(
    f"""
    WITH n AS (
      SELECT lang, 'EMAIL_ADDRESS' AS entity_type, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents
      UNION ALL SELECT lang, 'PHONE', len(regexp_extract_all(text, '{PHONE}')) FROM documents
      UNION ALL SELECT lang, 'IP_ADDRESS', len(regexp_extract_all(text, '{IP}')) FROM documents)
    SELECT lang, entity_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS placeholders FROM n GROUP BY ALL HAVING sum(n) > 0
    """
)
def flagship_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find spans, resolve overlaps, substitute placeholders; spans and placeholders by language and type."""
    docs = read(spark, sf_dir, "documents")
    found = settled(latin_spans(spark, sf_dir))
    texts, _ = pipeline.anonymize(docs, found, language="en")
    seen = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[(EMAIL|PHONE|IP_ADDRESS)_\d+\]"), 1)).alias("label"))
    seen = seen.groupBy("doc_id", F.when(F.col("label") == "EMAIL", "EMAIL_ADDRESS").otherwise(F.col("label")).alias("entity_type")).agg(F.count(F.lit(1)).alias("placeholders"))
    n = found.groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n")).join(seen, ["doc_id", "entity_type"], "left")
    return n.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "entity_type").agg(F.sum("n").alias("n"), F.coalesce(F.sum("placeholders"), F.lit(0)).alias("placeholders"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS text FROM documents")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latin_spans(spark, sf_dir).where("entity_type = 'EMAIL_ADDRESS'").select("doc_id", "text")


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{EMAIL}', '[X]', 'g'), '{PHONE}', '[X]', 'g')) AS sha FROM documents")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize.extract_spans(read(spark, sf_dir, "documents"), recognize.LATIN[:2]).withColumn("placeholder", F.lit("[X]"))
    return registry.substitute(read(spark, sf_dir, "documents"), found).select("doc_id", F.sha2("text", 256).alias("sha"))


# --- check digits ------------------------------------------------------------------------------------------------


def _ids(spark: SparkSession, sf_dir: str, digits: int) -> DataFrame:
    """A body of `digits` digits from each order's key, with every last digit of the key as check digit."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 % 10**digits).cast("string"), digits, "0").alias("body"), (F.col("o_orderkey") % 10).cast("string").alias("c"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0").alias("cc"))


def _body(digits: int) -> str:
    return f"lpad(CAST(o_orderkey * 7919 % {10**digits} AS VARCHAR), {digits}, '0')"


def _weighted(value: str, weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w} * CAST(substr({value}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights))


@query(f"WITH t AS (SELECT o_orderkey, {_body(9)} || CAST(o_orderkey % 10 AS VARCHAR) AS v FROM orders) SELECT o_orderkey, v AS id, ({_weighted('v', checksums.INN_10)}) % 11 % 10 = CAST(substr(v, 10, 1) AS INT) AS valid FROM t")
def inn_10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, 9).select("o_orderkey", F.concat("body", "c").alias("id")).withColumn("valid", checksums.inn_10(F.col("id")))


@query(
    f"""WITH t AS (SELECT o_orderkey, {_body(10)} || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS v FROM orders)
    SELECT o_orderkey, v AS id, ({_weighted('v', checksums.INN_12_FIRST)}) % 11 % 10 = CAST(substr(v, 11, 1) AS INT) AND ({_weighted('v', checksums.INN_12_SECOND)}) % 11 % 10 = CAST(substr(v, 12, 1) AS INT) AS valid FROM t"""
)
def inn_12_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, 10).select("o_orderkey", F.concat("body", "cc").alias("id")).withColumn("valid", checksums.inn_12(F.col("id")))


@query(f"WITH t AS (SELECT o_orderkey, {_body(12)} || CAST(o_orderkey % 10 AS VARCHAR) AS v FROM orders) SELECT o_orderkey, v AS id, CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = CAST(substr(v, 13, 1) AS INT) AS valid FROM t")
def ogrn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, 12).select("o_orderkey", F.concat("body", "c").alias("id")).withColumn("valid", checksums.ogrn(F.col("id")))


@query(f"WITH t AS (SELECT o_orderkey, {_body(14)} || CAST(o_orderkey % 10 AS VARCHAR) AS v FROM orders) SELECT o_orderkey, v AS id, CAST(substr(v, 1, 14) AS BIGINT) % 13 % 10 = CAST(substr(v, 15, 1) AS INT) AS valid FROM t")
def ogrnip_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, 14).select("o_orderkey", F.concat("body", "c").alias("id")).withColumn("valid", checksums.ogrnip(F.col("id")))


@query(
    f"""WITH t AS (SELECT o_orderkey, {_body(9)} || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS v FROM orders)
    SELECT o_orderkey, v AS id, CAST(substr(v, 1, 9) AS BIGINT) <= {checksums.SNILS_UNCHECKED} OR ({_weighted('v', checksums.SNILS)}) % 101 % 100 = CAST(substr(v, 10, 2) AS INT) AS valid FROM t"""
)
def snils_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir, 9).select("o_orderkey", F.concat("body", "cc").alias("id")).withColumn("valid", checksums.snils(F.col("id")))


# --- Russian texts -----------------------------------------------------------------------------------------------


def russian_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short contract for each order, with a valid tax id, a date, an amount, a name and a company."""
    rows = _ids(spark, sf_dir, 9).repartition(spark.sparkContext.defaultParallelism)  # a short table in one file, long work on each row
    check = sum((F.substring("body", i + 1, 1).cast("int") * w for i, w in enumerate(checksums.INN_10)), F.lit(0)) % 11 % 10
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Соглашение сторон\nИНН: "), "body", check.cast("string"), F.lit("\nпочта k"), key, F.lit("@example.ru\nсумма 1 "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" руб.\nФИО: Петров Иван Кузьмич\nОплатит ООО «Вектор"), key, F.lit("» до 05.03.2024 года")) 
    return rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


_RU = f"""t AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS k, {_body(9)} AS b, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS m FROM orders),
    u AS (SELECT doc_id, b || CAST(({_weighted('b', checksums.INN_10)}) % 11 % 10 AS VARCHAR) AS inn, 'k' || k || '@example.ru' AS mail, '1 ' || m || ' руб.' AS money, 'ООО «Вектор' || k || '»' AS org FROM t)"""


@query(
    f"""WITH {_RU} SELECT doc_id, 'RU_INN' AS entity_type, inn AS text, 23 AS start FROM u
    UNION ALL SELECT doc_id, 'EMAIL_ADDRESS', mail, 40 FROM u
    UNION ALL SELECT doc_id, 'MON', money, 47 + length(mail) FROM u
    UNION ALL SELECT doc_id, 'PER', 'Петров Иван Кузьмич', 53 + length(mail) + length(money) FROM u
    UNION ALL SELECT doc_id, 'ORG', org, 81 + length(mail) + length(money) FROM u
    UNION ALL SELECT doc_id, 'RU_DATE', '05.03.2024', 85 + length(mail) + length(money) + length(org) FROM u"""
)
def russian_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: recognizers, filters, policy, aliases, merges."""
    return pipeline.analyze(russian_texts(spark, sf_dir)).select("doc_id", "entity_type", "text", "start")


@query("SELECT o_orderkey AS doc_id, true AS restored, 6 AS n FROM orders")
def anonymize_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: substitute, restore from the mapping after a sealed export, compare."""
    docs = russian_texts(spark, sf_dir)
    texts, mapping = pipeline.anonymize(docs, pipeline.analyze(docs))
    mapping = registry.unseal(registry.seal(mapping.withColumn("session_id", F.col("session_id").cast("string")), b"k" * 32), b"k" * 32)
    named = texts.withColumn("session_id", F.col("doc_id").cast("string"))
    back, found = restore.restore(named, mapping, strict=True)
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return back.select("doc_id", F.col("text").alias("back")).join(dealt(docs), "doc_id").join(dealt(n), "doc_id").select("doc_id", (F.col("back") == F.col("text")).alias("restored"), "n")


@query(
    """WITH p AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN '[PERSON_1]' WHEN 1 THEN '[person_01]' WHEN 2 THEN '[PERSON-1]' WHEN 3 THEN '[PERSAN_1]' WHEN 4 THEN '[ЛИЦО_1]' ELSE '[PERSON_9]' END AS raw FROM orders)
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 5 THEN 'a [PERSON_9] b' ELSE 'a name' || CAST(o_orderkey AS VARCHAR) || ' b' END AS text, o_orderkey % 6 < 5 AS resolved FROM p"""
)
def distorted_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way in which a model may write a placeholder, in a registry with English labels."""
    k = F.col("o_orderkey") % 6
    raw = F.element_at(F.array(*map(F.lit, ("[PERSON_1]", "[person_01]", "[PERSON-1]", "[PERSAN_1]", "[ЛИЦО_1]", "[PERSON_9]"))), (k + 1).cast("int"))
    rows = read(spark, sf_dir, "orders")
    texts = rows.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("a "), raw, F.lit(" b")).alias("text"))
    value = F.concat(F.lit("name"), F.col("o_orderkey").cast("string"))
    mapping = rows.select(F.col("o_orderkey").alias("session_id"), F.lit("[PERSON_1]").alias("placeholder"), value.alias("canonical"), F.lit("PER").alias("entity_type"), F.array(value).alias("original_forms"), F.array(value).alias("surface_forms"))
    back, found = restore.restore(texts, mapping, language="en")
    return back.join(dealt(found.select("session_id", "doc_id", F.col("value").isNotNull().alias("resolved"))), ["session_id", "doc_id"]).select("doc_id", "text", "resolved")


@query(
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'insurance' WHEN 1 THEN 'internal_policy' WHEN 2 THEN 'registry_extract' WHEN 3 THEN 'legal_contract' ELSE 'generic' END AS profile FROM orders"""
)
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("Памятка: полис ДМС", "Положение о договоре", "Выписка, ОГРН и договор", "Договор аренды", "Письмо о погоде"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), policy.profile(text).alias("profile"))


@query(
    """WITH t AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS k FROM orders)
    SELECT doc_id, CASE k WHEN 0 THEN 'ignore' WHEN 1 THEN 'auto' WHEN 2 THEN 'review' WHEN 3 THEN 'auto' WHEN 4 THEN 'ignore' ELSE 'review' END AS action,
    CASE k WHEN 0 THEN 'stopword' WHEN 1 THEN 'fio_shape' WHEN 2 THEN 'weak_organization_candidate' WHEN 3 THEN 'strong_organization_signal' WHEN 4 THEN 'generic_location_descriptor' ELSE 'position_review_only' END AS reason FROM t"""
)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = (("Заказчик", "PER"), ("Петров Иван", "PER"), ("Вектор", "ORG"), ("ООО «Вектор Плюс»", "ORG"), ("Памятка клиента", "LOC"), ("Главный инженер", "POSITION"))
    pick = F.element_at(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(t).alias("t")) for v, t in values]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), pick.alias("p")).select("doc_id", F.col("p.v").alias("text"), F.col("p.t").alias("entity_type"), F.lit(0).alias("start"), F.char_length("p.v").alias("end"), F.col("p.v").alias("body"), F.lit("").alias("recognizer"))
    return policy.decide(rows).select("doc_id", F.col("policy_action").alias("action"), F.col("policy_reason").alias("reason"))


# --- spans from line items -----------------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an order's lines of one number, in the order of the table's files and their rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_partkey", "l_suppkey").alias("line"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("line", "place").alias("line")).select("l_orderkey", "l_linenumber", "line.*")


def item_spans(spark: SparkSession, sf_dir: str, kind: str = "PER", *more: str) -> DataFrame:
    """A span for each line of an order: it starts at ten times the line's number and is 6 to 10 characters long."""
    n = (6 + F.col("l_partkey") % 5).cast("int")
    start = (10 * F.col("l_linenumber")).cast("int")
    return items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.repeat(F.lit("x"), n).alias("text"), F.lit(kind).alias("entity_type"), start.alias("start"), (start + n).alias("end"),
        (F.col("l_suppkey") % 10 / 10).alias("score"), F.lit("ner").alias("source_layer"), F.lit("items").alias("recognizer"), F.lit("   ").alias("tail"), *more,
    )


_ITEMS = "i AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS doc_id, CAST(10 * l_linenumber AS INT) AS s, CAST(10 * l_linenumber + 6 + l_partkey % 5 AS INT) AS e, l_partkey, l_suppkey FROM lineitem)"


@query(
    f"""WITH {_ITEMS}, g AS (SELECT *, CASE WHEN s - lag(e) OVER w BETWEEN 0 AND 3 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM g)
    SELECT doc_id, min(s) AS start, max(e) AS "end", max(e) - min(s) AS length FROM h GROUP BY doc_id, grp"""
)
def adjacent_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_adjacent_persons(item_spans(spark, sf_dir)).select("doc_id", "start", "end", F.char_length("text").alias("length"))


@query(
    f"""WITH RECURSIVE {_ITEMS},
    o AS (SELECT doc_id, s, e + 10 AS e, (l_suppkey % 10) / 10 AS score, ['MON', 'PER', 'ORG', 'LOC'][e % 4 + 1] AS t, [90, 50, 45, 30][e % 4 + 1] AS p FROM i),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, score DESC, e DESC, t) AS n, {{'s': s, 'e': e, 'score': score, 't': t, 'p': p}} AS x FROM o),
    f AS (SELECT doc_id, n, [x] AS kept FROM n WHERE n = 1 UNION ALL
      SELECT n.doc_id, n.n, CASE WHEN n.s >= kept[-1].e THEN list_append(kept, x)
        WHEN n.p > kept[-1].p OR (n.p = kept[-1].p AND ((n.score >= 0.9) > (kept[-1].score >= 0.9) OR ((n.score >= 0.9) = (kept[-1].score >= 0.9) AND (n.score > kept[-1].score OR (n.score = kept[-1].score AND n.e - n.s > kept[-1].e - kept[-1].s)))))
        THEN list_append(kept[:-2], x) ELSE kept END FROM f JOIN n ON n.doc_id = f.doc_id AND n.n = f.n + 1),
    r AS (SELECT doc_id, unnest(arg_max(kept, n)) AS k FROM f GROUP BY doc_id)
    SELECT doc_id, k.s AS start, k.e AS "end", k.t AS entity_type, k.score AS score FROM r"""
)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans twice as long as the distance of their starts."""
    kinds = F.element_at(F.array(*map(F.lit, ("MON", "PER", "ORG", "LOC"))), (F.col("end") % 4 + 1).cast("int"))
    rows = item_spans(spark, sf_dir).withColumn("entity_type", kinds).withColumn("end", F.col("end") + 10)
    return spans.resolve_overlaps(rows).select("doc_id", "start", "end", "entity_type", "score")


_HALF = "a AS (SELECT * FROM i WHERE l_partkey % 2 = 0), b AS (SELECT doc_id, s + 5 AS s, e + 5 AS e FROM i WHERE l_partkey % 3 = 0)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = item_spans(spark, sf_dir, "PER", "l_partkey")
    return rows.where("l_partkey % 2 = 0").drop("l_partkey"), rows.where("l_partkey % 3 = 0").drop("l_partkey").withColumns({"start": F.col("start") + 5, "end": F.col("end") + 5})


@query(f"WITH {_ITEMS}, {_HALF} SELECT doc_id, s AS start, e AS \"end\" FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e)")
def new_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, found = _halves(spark, sf_dir)
    return spans.suggestions(current, found).select("doc_id", "start", "end")


@query(f"WITH {_ITEMS}, {_HALF} SELECT doc_id, s AS start, e AS \"end\" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e)")
def removal_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, found = _halves(spark, sf_dir)
    return spans.removals(current.withColumn("state", F.lit("pending")), found).select("doc_id", "start", "end")


@query(
    f"""WITH {_ITEMS}, {_HALF}, u AS (SELECT doc_id, s - 5 AS s, s + 8 AS e FROM b)
    SELECT doc_id, s AS start, e AS "end", false AS user_added FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE a.doc_id = u.doc_id AND a.s >= u.s AND a.e <= u.e) UNION ALL SELECT doc_id, s, e, true FROM u"""
)
def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, other = _halves(spark, sf_dir)
    added = other.withColumns({"end": F.col("start") + 8, "start": F.col("start") - 5}).withColumn("user_added", F.lit(True))
    return spans.add_user_spans(base.withColumn("user_added", F.lit(False)), added).select("doc_id", "start", "end", "user_added")


@query(f"WITH {_ITEMS} SELECT doc_id, s AS start, CASE WHEN l_partkey % 2 = 0 THEN 'P' || CAST(s AS VARCHAR) END AS placeholder, CASE WHEN l_partkey % 2 = 0 THEN 'accepted' ELSE 'pending' END AS state FROM i")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _halves(spark, sf_dir)
    old = old.withColumns({"id": F.lit("x"), "placeholder": F.concat(F.lit("P"), F.col("start").cast("string")), "state": F.lit("accepted"), "user_added": F.lit(False)})
    return spans.carry_state(item_spans(spark, sf_dir), old).select("doc_id", "start", "placeholder", "state")


@query(
    f"""WITH {_ITEMS}, p AS (SELECT doc_id, s, lag(e) OVER (PARTITION BY doc_id ORDER BY s) AS last, sum(8 - (e - s)) OVER (PARTITION BY doc_id ORDER BY s) - (8 - (e - s)) AS before FROM i)
    SELECT doc_id, CAST(s + before - 1 AS INT) AS right_start, CASE WHEN last = s THEN NULL ELSE CAST(s - 1 AS INT) END AS left_start FROM p"""
)
def offsets_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character before each placeholder of 8 characters, back in the source text."""
    rows = item_spans(spark, sf_dir).withColumn("placeholder", F.lit("[PERS_1]"))
    order = Window.partitionBy("doc_id").orderBy("start")
    before = F.coalesce(F.sum(8 - (F.col("end") - F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = (F.col("start") + before - 1).cast("int")
    points = rows.select("doc_id", at.alias("right_start"), at.alias("right_end"))
    return spans.offsets_before(rows, points).select("doc_id", "right_start", "left_start")


@query("SELECT doc_id, true AS whole FROM documents WHERE length(text) > 0")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at their spans; the pieces make up the text."""
    docs = read(spark, sf_dir, "documents")
    pieces = spans.segments(latin_spans(spark, sf_dir), docs)
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("t"))
    return docs.join(whole, "doc_id").select("doc_id", (F.col("t") == F.col("text")).alias("whole"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS c FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND l.l_partkey % 100 + 5 BETWEEN m.l_suppkey % 50 - 0.5 AND m.l_suppkey % 50 + 40.5 AND (m.l_quantity % 20) / 10.0 BETWEEN 0.32 AND 0.74 AND (least(l.l_partkey % 100 + 10, m.l_suppkey % 50 + 40) - greatest(l.l_partkey % 100, m.l_suppkey % 50)) / 10.0 >= 0.25)")
def struck_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that no line of their page crosses in the middle."""
    rows = read(spark, sf_dir, "lineitem")
    x = (F.col("l_partkey") % 100).cast("double")
    chars = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("c"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(10.0).alias("y1"))
    lx = (F.col("l_suppkey") % 50).cast("double")
    lines = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), lx.alias("x0"), (lx + 40).alias("x1"), (F.col("l_quantity") % 20).alias("y"), F.lit(None).cast("string").alias("color"))
    return sources.without_struck(chars, lines).select("doc_id", "c")


# --- sessions and events -------------------------------------------------------------------------------------------

FIRST, LAST = dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1)


def http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: errors have status 500, others 200; latency is the value."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), "user_id", "event_type", status.alias("status_code"), F.col("value").alias("latency_ms"), "props")


def _span_of(rows: DataFrame) -> tuple[dt.datetime, dt.datetime]:
    r = rows.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    return r["a"], r["b"]


@query(
    """WITH r AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
    c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT day, coalesce(n, 0) AS n, users FROM d LEFT JOIN c USING (day)"""
)
def sessions_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = http_events(spark, sf_dir)
    a, b = _span_of(rows)
    return analytics.per_day(rows.where("event_type = 'signup'"), "timestamp", a, b, F.count_distinct("user_id").alias("users"))


@query("SELECT CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95, CAST(round_even(quantile_cont(value, 0.99), 0) AS BIGINT) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.percentiles(http_events(spark, sf_dir), "latency_ms")


@query("SELECT CAST(ts AS DATE) AS day, round_even(100.0 * count(*) FILTER (event_type = 'error') / count(*), 2) AS error_rate FROM events GROUP BY 1")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_events(spark, sf_dir).groupBy(F.to_date("timestamp").alias("day")).agg(analytics.error_rate(F.col("status_code")).alias("error_rate"))


@query("SELECT count(DISTINCT user_id) AS active_users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = http_events(spark, sf_dir)
    return analytics.active_users(rows, "timestamp", "user_id", _span_of(rows)[1])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top(http_events(spark, sf_dir), "event_type", 3)


@query("SELECT entity_type, count(*) AS n FROM (SELECT user_id, unnest(['PER', CASE WHEN event_type = 'error' THEN 'ORG' ELSE 'LOC' END]) AS entity_type FROM events WHERE event_id % 7 <> 0) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("event_type") == "error", "ORG").otherwise("LOC")
    good = F.to_json(F.array(F.struct(F.lit("PER").alias("entity_type")), F.struct(second.alias("entity_type"))))
    return analytics.top_types(http_events(spark, sf_dir).select(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(good).alias("entities_json")))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def property_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_events(spark, sf_dir).groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.query(http_events(spark, sf_dir), "timestamp", "event_id", 20, event_type="error").select("event_id", "user_id")


@query("SELECT CASE WHEN value > 50 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2020-01-01' AND event_type = 'error' GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = http_events(spark, sf_dir).where("event_type = 'error'").withColumn("severity", F.when(F.col("latency_ms") > 50, "error").otherwise("warning"))
    return stores.severities(rows, FIRST)


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
def user_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.page(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.col("c_custkey")], 20, 10)


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = http_events(spark, sf_dir)
    return stores.prune(rows, "timestamp", _span_of(rows)[1], 5).select("event_id")


@query("SELECT o_custkey AS session_id, arg_max(o_orderstatus, o_orderkey) AS status, CASE WHEN o_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS user_id FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 'X', 'old' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sessions keep their owner; of several changes the last counts."""
    table = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("session_id"), F.lit("X").alias("status"), F.lit("old").alias("user_id"))
    changes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("status"), F.lit("new").alias("user_id"), "o_orderkey")
    return stores.upsert(table, changes, ["session_id"], order="o_orderkey")


@query("SELECT c_custkey AS feedback_id, arg_max(o_orderstatus, o_orderkey) AS reply, coalesce(arg_max(o_orderpriority, o_orderkey), 'new') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def feedback_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feedback_id"))
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feedback_id"), F.col("o_orderstatus").alias("reply"), F.col("o_orderpriority").alias("status"), F.col("o_orderkey").alias("at"))
    return stores.feedback_state(sent, log).drop("reply_at")


@query("SELECT event_id, '{\"k\":\"[REDACTED]\",\"type\":\"' || event_type || '\"}' AS payload FROM events")
def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    return http_events(spark, sf_dir).select("event_id", F.to_json(audit.redact(payload, ("k",))).alias("payload"))


@query("SELECT user_id, count(*) AS n, true AS sound FROM events GROUP BY 1")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events chained per user, then verified."""
    rows = audit.chain(http_events(spark, sf_dir).select("event_id", "user_id", "event_type", "status_code"), "user_id", "event_id", ["event_id", "user_id", "event_type", "status_code"])
    good = audit.verify(rows, "user_id", "event_id", ["event_id", "user_id", "event_type", "status_code"])
    return good.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("linked") & F.col("intact")).alias("sound"))


@query(
    """WITH a AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS t, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok FROM events),
    r AS (SELECT *, coalesce(sum(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round FROM a),
    f AS (SELECT x.event_id, (SELECT count(*) FROM r y WHERE y.user_id = x.user_id AND y.round = x.round AND y.ok = 0 AND y.t >= x.t - 864000 AND (y.t < x.t OR (y.t = x.t AND y.event_id < x.event_id))) AS failures FROM r x)
    SELECT event_id, failures, failures >= 3 AS blocked FROM f"""
)
def login_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an attempt, a purchase one that succeeds; windows of ten days, as events are far apart."""
    rows = http_events(spark, sf_dir).select(F.lit("ip").alias("ip"), F.col("user_id").cast("string").alias("username"), F.col("timestamp").alias("ts"), F.col("event_id").alias("attempt_id"), (F.col("event_type") == "purchase").alias("success"))
    return audit.login_blocks(rows, seconds=864000, most=3).select(F.col("attempt_id").alias("event_id"), "failures", "blocked")


@query(
    """WITH e AS (SELECT *, event_id % 5 AS k FROM events) SELECT CASE k WHEN 0 THEN 'auth.login' WHEN 1 THEN 'anonymize.done' WHEN 2 THEN 'admin.users.list' ELSE 'session.info' END AS event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM e WHERE k < 4 GROUP BY 1"""
)
def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("event_id") % 5 + 1).cast("int")
    method = F.element_at(F.array(*map(F.lit, ("POST", "POST", "GET", "GET", "GET"))), k)
    path = F.element_at(F.array(*map(F.lit, ("/api/auth/login", "/api/sessions/a1/anonymize", "/api/admin/users", "/api/sessions/77", "/static/x.js"))), k)
    rows = http_events(spark, sf_dir).select(F.col("timestamp").alias("ts"), (F.col("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("done"), method.alias("method"), path.alias("path"), "status_code", "user_id", F.lit("ip").alias("client_ip"), F.lit("ua").alias("user_agent"), F.lit(1).alias("response_size"))
    return audit.telemetry(rows).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status_code") == 500).cast("long")).alias("errors"))


# --- evaluation, comparison, text ----------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT DISTINCT doc_id, CASE WHEN text LIKE '%!!%' OR text LIKE '%$$$%' THEN 'low' ELSE 'high' END AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), t AS (SELECT DISTINCT doc_id, CASE WHEN quality = 0 THEN 'low' ELSE 'high' END AS k FROM labels),
    j AS (SELECT coalesce(d.k, t.k) AS entity_type, d.k IS NOT NULL AND t.k IS NOT NULL AS tp, t.k IS NULL AS fp, d.k IS NULL AS fn FROM d FULL JOIN t ON d.doc_id = t.doc_id AND d.k = t.k),
    c AS (SELECT entity_type, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j GROUP BY 1)
    SELECT entity_type, tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for low quality, held against the labels."""
    labels = read(spark, sf_dir, "labels")
    guess = F.when(F.col("text").contains("!!") | F.col("text").contains("$$$"), "low").otherwise("high")
    found = read(spark, sf_dir, "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("doc"), F.lit("q").alias("text"), guess.alias("entity_type"))
    truth = labels.select(F.col("doc_id").cast("string").alias("doc"), F.lit("q").alias("text"), F.when(F.col("quality") == 0, "low").otherwise("high").alias("entity_type"))
    out = evaluate.sums(evaluate.compare(found, truth), "entity_type")
    return out.select("entity_type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH a AS (SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS first FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS last FROM customer WHERE c_nationkey >= 5 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, first, last, round(last - first, 3) AS delta FROM a FULL JOIN b ON a.k = b.k")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), "c_acctbal", "c_nationkey")
    run = lambda test: rows.where(test).groupBy("k").agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    out = evaluate.compare_runs([("first", run("c_nationkey < 20")), ("last", run("c_nationkey >= 5"))], "k", "v")
    return out.withColumn("delta", F.round("delta", 3))


@query("SELECT conv_id, turn, true AS old_restored, true AS new_restored FROM conversations WHERE turn > 0")
def word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before; both texts follow from the operations."""
    rows = read(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    pairs = rows.select("conv_id", "turn", F.col("text").alias("new")).join(dealt(before, "conv_id", "turn"), ["conv_id", "turn"])
    side = lambda kind: F.array_join(F.transform(F.filter("ops", lambda o: o["kind"] != kind), lambda o: o["text"]), "")
    return diff.word_diff(pairs).select("conv_id", "turn", (side("ins") == F.col("old")).alias("old_restored"), (side("del") == F.col("new")).alias("new_restored"))


@query("SELECT o_orderkey AS doc_id, 1 AS old_block, 3 AS new_block FROM orders UNION ALL SELECT o_orderkey, 3, 1 FROM orders")
def moved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose first and last sections change places."""
    body = lambda n: F.concat(F.lit(f"{n}. Section {'abc'[n - 1]}\n{n}.1 The party numbered "), F.col("o_orderkey").cast("string"), F.lit(f" of part {'xyz'[n - 1]} delivers goods and pays for them within thirty days of the invoice date"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)  # a short table in one file, long work on each row
    text = lambda order: F.concat_ws("\n", *[body(n) for n in order])
    old, new = (rows.select(F.col("o_orderkey").alias("doc_id"), text(o).alias("text")) for o in ((1, 2, 3), (3, 2, 1)))
    return diff.moved_blocks(old, new).where("old_block <> new_block").select("doc_id", F.col("old_block").cast("int").alias("old_block"), F.col("new_block").cast("int").alias("new_block"))


@query("SELECT doc_id, 0 AS first, length(text) AS last FROM documents WHERE length(trim(text)) > 0")
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks reach from a text's first to its last character."""
    return chunks.chunk(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.min("start").cast("int").alias("first"), F.max("end").cast("long").alias("last"))


@query("SELECT doc_id, true AS slices, true AS numbered, true AS close, 0 AS lost FROM documents WHERE length(trim(text)) > 0")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk is a slice of its text of the right size, chunks are numbered in order, neighbours overlap by what is asked at most, and what no chunk holds is blank."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    rows = chunks.chunk(docs.withColumnRenamed("body", "text")).join(docs, "doc_id")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.coalesce(F.lag("end").over(order), F.lit(0))
    slice_ = (F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")) & (F.col("end") - F.col("start") <= 4 * 500) & (F.col("token_count") == F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)))
    gap = F.char_length(F.regexp_replace(F.substring("body", before + 1, F.greatest(F.col("start") - before, F.lit(0))), r"(?U)\s", ""))
    rows = rows.select("doc_id", slice_.alias("slice"), (F.col("chunk_id") == F.row_number().over(order) - 1).alias("nr"), (before - F.col("start") <= 4 * 50).alias("near"), gap.alias("gap"))
    return rows.groupBy("doc_id").agg(F.bool_and("slice").alias("slices"), F.bool_and("nr").alias("numbered"), F.bool_and("near").alias("close"), F.sum("gap").cast("int").alias("lost"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS x FROM v q, v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(x, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""
)
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return chunks.top_chunks(asked, rows).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    """WITH c AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k, 'x' || CAST(o_orderkey AS VARCHAR) AS name FROM orders)
    SELECT doc_id, 'Петров' AS text, 0 AS start FROM c UNION ALL SELECT doc_id, 'Петров А. Н.', 8 FROM c UNION ALL SELECT doc_id, name, 21 FROM c WHERE k = 0"""
)
def claimed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where restored values stand in a text, longest first."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("name"))
    texts = rows.select("doc_id", F.concat(F.lit("Петров, Петров А. Н. "), F.when(F.col("doc_id") % 3 == 0, F.col("name")).otherwise(F.lit("nobody"))).alias("text"))
    values = rows.select("doc_id", F.explode(F.array(F.lit("Петров"), F.lit("Петров А. Н."), F.col("name"), F.lit(""))).alias("text"))
    return spans.claims(texts, values).select("doc_id", "text", "start")


@query(
    """WITH p AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations), q AS (SELECT *, e - length(text) AS s FROM p)
    SELECT conv_id AS doc_id, CAST(s AS BIGINT) AS at, turn AS seg, CAST(0 AS BIGINT) AS local FROM q WHERE length(text) > 0 UNION ALL SELECT conv_id, CAST(s + length(text) // 2 AS BIGINT), turn, CAST(length(text) // 2 AS BIGINT) FROM q WHERE length(text) > 1"""
)
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the middle character of each turn, as offsets of the whole conversation, back in their turns."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg"), "text")
    n = F.char_length("text")
    start = F.sum(n).over(Window.partitionBy("doc_id").orderBy("seg")) - n
    points = rows.select("doc_id", "text", start.alias("s"))
    asked = points.where("char_length(text) > 0").select("doc_id", F.col("s").alias("at")).union(points.where("char_length(text) > 1").select("doc_id", F.col("s") + F.floor(F.char_length("text") / 2)))
    return spans.resolve_offsets(rows, asked)


@query("SELECT event_id AS session_id, length('[PERSON_1] wrote ' || event_type || ' to [ORG_2]') AS char_count, 2 AS placeholder_count, user_id % 2 = 0 AS old_result FROM events WHERE user_id % 2 = 1 UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE user_id % 2 = 0")
def imported_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's texts stored with their lengths and placeholders; a session's earlier result goes with its new text."""
    rows = read(spark, sf_dir, "events")
    sessions = rows.select(F.col("event_id").alias("session_id"), F.lit("old").alias("response_text"), F.lit("{}").alias("result_json"))
    texts = rows.where("user_id % 2 = 1").select(F.col("event_id").alias("session_id"), F.concat(F.lit("[PERSON_1] wrote "), "event_type", F.lit(" to [ORG_2]")).alias("text"))
    out = stores.import_responses(sessions, texts)
    return out.select("session_id", "char_count", "placeholder_count", F.col("result_json").isNotNull().alias("old_result"))


@query("SELECT user_id AS session_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def stored_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans of sessions, counted by type."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.to_json(F.collect_list(F.struct(F.lit("x").alias("text"), F.col("event_type").alias("entity_type")))).alias("entities_json"))
    out = stores.stored_spans(rows.withColumn("anonymized_text", F.lit("t")))
    return out.select("session_id", F.size("entities").cast("long").alias("n"), F.coalesce(F.try_element_at("stats", F.lit("error")), F.lit(0)).cast("long").alias("errors"))


_USERS = "u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer WHERE c_custkey % 5 <> 0)"


@query(
    f"""WITH {_USERS} SELECT id AS user_id, CASE WHEN id % 4 = 1 AND id <> 1 THEN 'user' ELSE role END AS role, id % 4 <> 2 AS is_active, id % 4 = 2 AS changed FROM u WHERE id % 4 <> 3
    UNION ALL SELECT c_custkey, 'user', true, false FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0"""
)
def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after an admin's changes: roles, accounts that are disabled, deleted and created; what touches the admin's own account is refused."""
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey")
    users = rows.where("c_custkey % 5 <> 0").select(key.alias("user_id"), F.when(key % 3 == 0, "admin").otherwise("user").alias("role"), F.lit(True).alias("is_active"), F.lit("old").alias("email"), F.lit(None).cast("string").alias("display_name"))
    none = F.lit(None).cast("string")
    change = lambda test, action, role, active, email: rows.where(test).select(key.alias("user_id"), F.lit(action).alias("action"), role.alias("role"), active.cast("boolean").alias("is_active"), email.alias("email"), none.alias("display_name"))
    changes = change("c_custkey % 4 = 1 AND c_custkey % 5 <> 0", "update", F.lit("user"), F.lit(None), none)
    changes = changes.union(change("c_custkey % 4 = 2", "update", none, F.lit(False), F.lit("new"))).union(change("c_custkey % 4 = 3 AND c_custkey % 5 <> 0", "delete", none, F.lit(None), none))
    changes = changes.union(change("c_custkey % 5 = 0 AND c_custkey % 2 = 0", "create", F.lit("user"), F.lit(True), F.lit("made")))
    changes = changes.where("NOT (action = 'update' AND user_id % 5 = 0)")
    out, refused = stores.change_users(users, changes, 1)
    return out.select("user_id", "role", "is_active", (F.col("email") == "new").alias("changed"))


@query(
    f"""WITH {_ITEMS}, {_HALF} SELECT doc_id, s AS start, 'new' AS kind FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e)
    UNION ALL SELECT doc_id, s, 'gone' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e)"""
)
def reviewed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions and removals side by side, as a second look at a text gives them."""
    current, found = _halves(spark, sf_dir)
    new = spans.suggestions(current, found).select("doc_id", "start", F.lit("new").alias("kind"))
    return new.union(spans.removals(current.withColumn("state", F.lit("pending")), found).select("doc_id", "start", F.lit("gone").alias("kind")))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files appended to those of a session keep their order: numbers are gapless and the last file is the newest."""
    rows = http_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "event_id", F.col("event_id").cast("string").alias("name"), F.lit("t").alias("text"))
    order = Window.partitionBy("session_id").orderBy("event_id")
    middle = rows.groupBy("session_id").agg(F.avg("event_id").alias("m"))
    split = rows.join(middle, "session_id")
    part = lambda test: split.where(test).withColumn("n", F.row_number().over(order) - 1).select("session_id", "n", "name", "text")
    out = stores.upload(part("event_id <= m"), part("event_id > m"), "append")
    return out.groupBy("session_id").agg((F.max("n") + 1).cast("long").alias("n"), F.max_by("name", "n").cast("long").alias("last")).withColumnRenamed("session_id", "user_id")


@query(
    """WITH t AS (SELECT conv_id, turn, greatest((length(text) + 8) // 3, 1) AS i FROM conversations) SELECT conv_id, turn, i AS input_tokens, CAST(floor(i * 0.3) AS BIGINT) AS output_tokens, CAST(floor(i * 0.5) AS BIGINT) AS thinking_tokens,
    round_even(i / 1000000.0 * 3.0 + floor(i * 0.3) / 1000000.0 * 15.0 + floor(i * 0.5) / 1000000.0 * 15.0, 6) AS total_cost FROM t"""
)
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("prompt").alias("prompt"), "text")
    return models.cost(rows).select("conv_id", "turn", "input_tokens", "output_tokens", "thinking_tokens", "total_cost")


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(text, '' ORDER BY turn)) AS sha FROM conversations GROUP BY 1")
def gathered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a conversation put together in order, as the stream operator does."""
    rows = read(spark, sf_dir, "conversations")
    parts = rows.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("long").alias("seq"), F.lit("text").alias("kind"), F.col("text").alias("content"))
    ends = rows.select(F.col("conv_id").cast("string").alias("request_id")).distinct().select("request_id", F.lit(2**40).alias("seq"), F.lit("done").alias("kind"), F.lit(None).cast("string").alias("content"))
    return models.gathered(parts.union(ends)).select(F.col("request_id").cast("long").alias("conv_id"), "n", F.sha2("whole", 256).alias("sha"))


@query("SELECT lang || '/' || doc_id // 100 AS bundle, sha256(string_agg(trim(text, E' \\t\\r\\n'), E'\\n\\n' ORDER BY doc_id)) AS sha, CAST(sum(n_chars) AS BIGINT) AS page_count FROM documents WHERE length(trim(text, E' \\t\\r\\n')) > 0 GROUP BY 1")
def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each language and hundred ids, so that no bundle grows with the table."""
    block = F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    rows = read(spark, sf_dir, "documents").select(block.alias("bundle"), "doc_id", "text", F.col("n_chars").alias("page_count"), F.lit(False).alias("ocr_used"), F.lit(None).cast("array<string>").alias("warnings"))
    return sources.combined_digests(rows, "bundle", "doc_id")


@query("SELECT o_orderkey AS doc_id, 'RU_PHONE' AS entity_type, 'x' || CAST(o_orderkey AS VARCHAR) AS text, 2 AS start FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'MON', 'x' || CAST(o_orderkey AS VARCHAR), 2 FROM orders WHERE o_orderkey % 3 = 1")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from a model's JSON, with names to be mapped and rows to be skipped, put where their text is."""
    k = F.col("o_orderkey") % 3
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("a x"), F.col("o_orderkey").cast("string")).alias("text"))
    kind = F.when(F.col("doc_id") % 3 == 0, "phone").when(F.col("doc_id") % 3 == 1, "Amount").otherwise("PER|ORG")
    span = F.struct(F.substring("text", 3, 40).alias("text"), kind.alias("entity_type"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(1.5).alias("score"))
    answered = docs.select("doc_id", F.to_json(F.struct(F.array(span).alias("verified"))).alias("answer"))
    return spans.realign(models.answer_spans(answered), docs).select("doc_id", "entity_type", "text", "start")


STOP_VALUES = tuple(dict.fromkeys((*fixed.FIELDS, *fixed.PRODUCTS, *fixed.POSITIONS, *golden.ROLE_FORMS, *fixed.NO_ORGANIZATIONS, *fixed.NO_PLACES, "сотрудниками бюро", "заявки заказчика", "генерального директора", *golden.NAMES, *golden.SURNAMES)))
_in = lambda words: "(" + ", ".join("'" + w + "'" for w in words) + ")"
_LABELS = (*golden.ROLE_FORMS, *fixed.POSITIONS, *fixed.FIELDS)


@query(
    f"""WITH v AS (SELECT unnest([{", ".join("'" + v + "'" for v in STOP_VALUES)}]) AS text, unnest(range({len(STOP_VALUES)})) AS i),
    r AS (SELECT o_orderkey AS doc_id, text, ['PER', 'ORG', 'LOC'][o_orderkey // {len(STOP_VALUES)} % 3 + 1] AS entity_type FROM orders JOIN v ON o_orderkey % {len(STOP_VALUES)} = i),
    t AS (SELECT *, regexp_replace(lower(text), '[:;,.!?-]+$', '') AS v FROM r), u AS (SELECT *, regexp_extract_all(replace(v, 'ё', 'е'), '[а-яёa-z]+') AS parts FROM t)
    SELECT doc_id, entity_type, text, length(v) <= 2 OR v IN {_in((*_LABELS, *fixed.PRODUCTS))} OR replace(v, 'ё', 'е') IN {_in(_LABELS)} OR text = 'генерального директора'
      OR (len(parts) >= 2 AND list_bool_and(list_transform(parts, lambda x: x IN {_in(_LABELS)})))
      OR (entity_type <> 'ORG' AND len(parts) > 0 AND list_bool_and(list_transform(parts, lambda x: regexp_matches(x, '^(?:{"|".join(fixed.PERSON_PLACE_ROOTS)})'))))
      OR (entity_type = 'ORG' AND (v IN {_in(fixed.NO_ORGANIZATIONS)} OR v LIKE 'выписка %')) OR (entity_type = 'LOC' AND v IN {_in(fixed.NO_PLACES)}) AS stop FROM u"""
)
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stop word and some names, as a person, an organization and a place."""
    n = len(STOP_VALUES)
    value = F.element_at(F.array(*map(F.lit, STOP_VALUES)), (F.col("o_orderkey") % n + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("PER", "ORG", "LOC"))), (F.floor(F.col("o_orderkey") / n) % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), value.alias("text"), kind.alias("entity_type"))
    return filters.flag_stopwords(rows).select("doc_id", "entity_type", "text", "stop")


def golden_texts(spark: SparkSession, sf_dir: str, marked: tuple[str, ...]) -> DataFrame:
    """One of the texts for each customer."""
    pick = F.element_at(F.array(*[F.lit(golden.text(m)) for m in marked]), (F.col("c_custkey") % len(marked) + 1).cast("int"))
    return read(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism).select(F.col("c_custkey").alias("doc_id"), pick.alias("text"))


def _golden_sql(marked: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{kind}', '{value}', {start})" for i, m in enumerate(marked) for kind, value, start in golden.spans(m))
    return f"SELECT c_custkey AS doc_id, entity_type, text, start FROM customer JOIN (VALUES {rows}) AS g(i, entity_type, text, start) ON c_custkey % {len(marked)} = i"


@query(_golden_sql(golden.MARKED))
def golden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recognizer on whole contracts, extracts, policies and notes: all marked spans and no others."""
    return pipeline.analyze(golden_texts(spark, sf_dir, golden.MARKED)).select("doc_id", "entity_type", "text", "start")


@query(_golden_sql((golden.LAYERS,)))
def golden_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans beside the patterns', with wrong offsets; labels, currencies, durations, products and places behind phones go."""
    docs = golden_texts(spark, sf_dir, (golden.LAYERS,))
    given = F.array(*[F.struct(F.lit(v).alias("text"), F.lit(k).alias("entity_type")) for k, v in golden.EXTRA])
    extra = docs.select("doc_id", F.inline(given)).select("doc_id", "text", "entity_type", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.8).alias("score"), F.lit("ner").alias("source_layer"), F.lit("model").alias("recognizer"))
    return pipeline.analyze(docs, extra=extra).select("doc_id", "entity_type", "text", "start")


POLICY_CASES = (
    # text, value, type, recognizer, action, reason
    ("Письмо", "Заказчик", "PER", "", "ignore", "stopword"),
    ("Письмо", "aria", "ORG", "", "ignore", "stopword"),
    ("Письмо", "реклама", "ORG", "", "ignore", "public_service_or_product"),
    ("звонить 8 800 123-45-67", "8 800 123-45-67", "RU_PHONE", "", "ignore", "public_support_phone"),
    ("Письмо", "a@b.ru", "EMAIL_ADDRESS", "", "auto", "structured_type"),
    ("Письмо", "Инструменты", "ORG", "", "ignore", "generic_org_descriptor"),
    ("от ООО «Вектор Плюс» всем", "ООО «Вектор Плюс»", "ORG", "", "auto", "strong_organization_signal"),
    ("by Acme Ltd.", "Acme Ltd.", "ORG", "English Legal Entity Recognizer", "auto", "strong_organization_signal"),
    ("Адвокатское бюро «Ковалёв»", "Адвокатское бюро «Ковалёв»", "ORG", "", "auto", "strong_organization_signal"),
    ("полис ДМС Вектор", "Вектор", "ORG", "", "ignore", "weak_org_in_public_or_policy_text"),
    ("Письмо от ООО", "ООО банк", "ORG", "", "review", "legal_form_without_distinctive_tail"),
    ("Письмо", "Вектор", "ORG", "", "review", "weak_organization_candidate"),
    ("Письмо", "Памяткой", "PER", "", "ignore", "stopword"),
    ("Письмо", "Медицинск", "PER", "", "ignore", "stopword"),
    ("Письмо", "Настоящий", "PER", "", "ignore", "generic_person_descriptor"),
    ("Письмо", "Петров Иван", "PER", "", "auto", "fio_shape"),
    ("директор: Кузьма", "Кузьма", "PER", "", "auto", "person_context"),
    ("полис и Пульсар", "Пульсар", "PER", "", "ignore", "weak_single_token_person"),
    ("Письмо Пульсару", "Пульсару", "PER", "", "auto", "person_model_candidate"),
    ("Письмо", "Настоящем", "LOC", "", "ignore", "generic_location_descriptor"),
    ("8 (916) 123-45-67 Омск", "Омск", "LOC", "", "ignore", "phone_routing_location"),
    ("полис ДМС, Омск", "Омск", "LOC", "", "ignore", "weak_location_in_public_or_policy_text"),
    ("город Омск", "Омск", "LOC", "", "auto", "location_model_candidate"),
    ("Письмо", "Главный инженер", "POSITION", "", "review", "position_review_only"),
    ("Письмо", "код Х", "SECRET_KIND", "", "review", "unknown_type_review_only"),
)


@query(f"SELECT o_orderkey AS doc_id, action, reason FROM orders JOIN (VALUES {', '.join(f"({i}, '{c[4]}', '{c[5]}')" for i, c in enumerate(POLICY_CASES))}) AS p(i, action, reason) ON o_orderkey % {len(POLICY_CASES)} = i")
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the policy that a span may come to."""
    cases = F.array(*[F.struct(F.lit(b).alias("body"), F.lit(v).alias("text"), F.lit(k).alias("entity_type"), F.lit(r).alias("recognizer"), F.lit(max(b.find(v), 0)).alias("start"), F.lit(max(b.find(v), 0) + len(v)).alias("end")) for b, v, k, r, *_ in POLICY_CASES])
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.element_at(cases, (F.col("o_orderkey") % len(POLICY_CASES) + 1).cast("int")).alias("c")).select("doc_id", "c.*")
    return policy.decide(rows).select("doc_id", F.col("policy_action").alias("action"), F.col("policy_reason").alias("reason"))


@query("SELECT o_orderkey AS doc_id, 'tax 500 of 500 000, ' || CASE WHEN o_orderkey % 2 = 0 THEN '[NAME_1]' ELSE 'nobody' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS applied FROM orders")
def values_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by placeholders; a number inside a larger one stays."""
    rows = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("Mr. $"), F.col("o_orderkey").cast("string"))
    docs = rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("tax 500 of 500 000, "), F.when(F.col("o_orderkey") % 2 == 0, name).otherwise(F.lit("nobody"))).alias("text"))
    values = rows.select(F.col("o_orderkey").alias("doc_id"), name.alias("old"), F.lit("[NAME_1]").alias("new")).union(rows.select("o_orderkey", F.lit("00 000"), F.lit("[N]")))
    return registry.substitute_by_value(docs, values).select("doc_id", "text", "applied")
