"""Queries of smaller operators over the test tables, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.functions import text
from veilstream.operators import analytics, diff, evaluate, filters, models, recognize, registry, restore, spans, stores
from veilstream.plans.registered import query, read
from veilstream.sources import documents
from veilstream.sources.tables import dealt


@query("SELECT o_orderkey, lower(trim(regexp_replace(trim(' ' || o_orderpriority || [':', ' !?', ';;', ''][o_orderkey % 4 + 1] || ' '), '[:;,.!?-]+$', ''))) AS key FROM orders")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (":", " !?", ";;", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", evaluate.match_key(F.concat(F.lit(" "), "o_orderpriority", tail, F.lit(" "))).alias("key"))


@query("SELECT url, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 128) AS segment, regexp_replace(coalesce(nullif(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', ''), ''), 'document'), '[\\\\/:*?\"<>|\\r\\n]', '_', 'g') || '.docx' AS file FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("url", text.safe_segment(F.col("url")).alias("segment"), documents.download_name(F.col("url"), "docx").alias("file"))


@query("SELECT event_id, (SELECT max(ts) FROM events) - ts > INTERVAL 100 HOUR AS gone FROM events")
def expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", text.expired(F.col("ts"), F.lit(rows.agg(F.max("ts")).first()[0]), 100).alias("gone"))


@query("SELECT event_id AS session_id FROM events WHERE event_id = 7 AND user_id = (SELECT user_id FROM events WHERE event_id = 7) AND (SELECT max(ts) FROM events) - ts <= INTERVAL 24000 HOUR")
def loaded_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at"))
    owner = rows.where("session_id = 7").select("user_id").collect()
    return stores.load_session(rows, 7, owner[0]["user_id"] if owner else -1, rows.agg(F.max("created_at")).first()[0], 24_000).select("session_id")


@query("SELECT event_id, least(event_id % 6, CASE WHEN event_id % 5 = 4 THEN 4 WHEN event_id % 5 = 3 THEN 3 WHEN event_id % 5 = 2 THEN 2 WHEN event_id % 5 = 1 THEN 1 ELSE 0 END) AS stage FROM events")
def workflow_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    flags = {"has_document": k >= 1, "has_anonymized": k >= 2, "has_response": k >= 3, "has_restored": k >= 4}
    return stores.workflow_stage(read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).alias("stage")).withColumns(flags)).select("event_id", "stage")


_KINDS = "WITH s AS (SELECT l_orderkey, l_linenumber, ['PER', 'ORG', 'LOC'][l_partkey % 3 + 1] AS entity_type, ['pending', 'accepted', 'rejected', NULL][l_suppkey % 4 + 1] AS state, CASE WHEN l_partkey % 5 > 0 THEN '[X_1]' END AS placeholder, CASE WHEN l_partkey % 7 > 0 THEN 'x' ELSE '' END AS text FROM lineitem)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(("PER", "ORG", "LOC"), part % 3).alias("entity_type"), pick(("pending", "accepted", "rejected", None), supp % 4).alias("state"),
        F.when(part % 5 > 0, "[X_1]").alias("placeholder"), F.when(part % 7 > 0, "x").otherwise("").alias("text"),
    )


@query(f"{_KINDS} SELECT l_orderkey, l_linenumber FROM s WHERE entity_type <> 'ORG' AND coalesce(state, 'pending') = 'pending'")
def visible_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible(_states(spark, sf_dir), ["ORG"]).select("l_orderkey", "l_linenumber")


@query(f"{_KINDS} SELECT l_orderkey, l_linenumber FROM s WHERE coalesce(state, '') <> 'rejected' AND text <> '' AND placeholder IS NOT NULL")
def exportable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exportable(_states(spark, sf_dir)).select("l_orderkey", "l_linenumber")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'server' ELSE 'client' END AS source, count(*) AS n FROM events GROUP BY 1")
def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("event_id") % 3 == 0, "/api/x").when(F.col("event_id") % 3 == 1, "/page")
    return stores.error_source(read(spark, sf_dir, "events").select(path.alias("path"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS unread FROM events WHERE ts > TIMESTAMP '2024-01-03' AND event_type = 'click'")
def unread_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", F.col("ts")).alias("reply_at"))
    return stores.unread_replies(rows, dt.datetime(2024, 1, 3))


@query("SELECT c_custkey AS session_id, c_custkey % 2 = 0 AS has_docx, coalesce(n, 0) AS entity_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey = 3")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(b"x")).alias("docx"), F.lit(dt.datetime(2024, 1, 1)).alias("created_at"))
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.count(F.lit(1)).alias("entity_count"))
    return stores.list_sessions(table, 3, ("docx",), counts).select("session_id", "has_docx", "entity_count")


@query(
    """WITH r AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r),
    c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round_even(quantile_cont(value, 0.5), 0) AS p50, round_even(quantile_cont(value, 0.95), 0) AS p95, round_even(100.0 * count(*) FILTER (event_type = 'error') / count(*), 2) AS error_rate, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1)
    SELECT day, coalesce(n, 0) AS n, p50, p95, error_rate, active_users FROM d LEFT JOIN c USING (day)"""
)
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), "user_id", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("value").alias("latency_ms"))
    a, b = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    return analytics.summary(rows, a, b)


@query("SELECT event_type AS entity_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def spans_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("text"))
    return analytics.grouped_spans(rows).select("entity_type", "n", F.col("spans")[0]["doc_id"].alias("first"))


@query("WITH t AS (SELECT DISTINCT event_type FROM events) SELECT event_type AS entity_type, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) AS place FROM t")
def type_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.legend(read(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type")), ["purchase", "click"])
    return rows.coalesce(1).select("entity_type", (F.monotonically_increasing_id() + 1).alias("place"))  # a handful of types


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("name"), F.col("o_orderkey").cast("string"))
    forms = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("Mr. "), name))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit("[PERSON_1]").alias("placeholder"), name.alias("canonical"), F.lit("PER").alias("entity_type"), forms.alias("original_forms"), forms.alias("surface_forms"))


@query("SELECT o_orderkey AS doc_id, 'to ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Mr. ' ELSE '' END || 'name' || o_orderkey || ' or [PERSON_2]' AS text FROM orders")
def plainly_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders by the first original form, else the canonical value."""
    texts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").alias("doc_id"), F.lit("to [PERSON_1] or [PERSON_2]").alias("text"))
    return registry.restore_text(texts, _mapping(spark, sf_dir)).select("doc_id", "text")


@query("SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'right' ELSE 'name' || o_orderkey END AS canonical, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS forms FROM orders")
def corrected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("session_id"), F.lit("[PERSON_1]").alias("placeholder"), F.lit("right").alias("value"))
    return registry.correct(_mapping(spark, sf_dir), fixes).select("session_id", "canonical", F.size("original_forms").alias("forms"))


@query("SELECT o_orderkey AS session_id, 1 AS entity_count, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS forms FROM orders")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = _mapping(spark, sf_dir)
    forms = registry.entries(mapping).groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("forms"))
    return registry.entity_counts(mapping).join(dealt(forms), "session_id").select("session_id", F.col("entity_count").cast("int").alias("entity_count"), "forms")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 2 THEN 'see [PERSON_1]' ELSE 'see me' || o_orderkey END AS text, CASE WHEN o_orderkey % 3 = 2 THEN 'CUSTOM' ELSE 'PER' END AS entity_type FROM orders")
def manually_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value given by hand goes before the mapping; without either the placeholder stays; types by placeholder."""
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders")
    texts = rows.select(key.alias("session_id"), key.alias("doc_id"), F.lit("see [PERSON_1]").alias("text"))
    mine = F.concat(F.lit("me"), key.cast("string"))
    mapping = _mapping(spark, sf_dir).where("session_id % 3 < 2").withColumns({"canonical": F.concat(F.lit("me"), F.col("session_id").cast("string")), "original_forms": F.array().cast("array<string>"), "surface_forms": F.when(F.col("session_id") % 3 == 1, F.array(F.lit("wrong"))).otherwise(F.array().cast("array<string>"))})
    manual = rows.where("o_orderkey % 3 = 1").select(key.alias("session_id"), F.lit("[PERSON_1]").alias("raw"), mine.alias("value"))
    back, found = restore.restore(texts, mapping, manual, language="en")
    return back.join(dealt(restore.with_types(found, mapping).select("session_id", "doc_id", "entity_type")), ["session_id", "doc_id"]).select("doc_id", "text", "entity_type")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 8 ELSE 3 END AS start, CASE o_orderkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 12 ELSE 7 END AS \"end\" FROM orders")
def refitted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span moves to the only place of its text nearby; where there are two it stays."""
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders")
    body = F.when(key % 3 == 0, "one two name three").when(key % 3 == 1, "one two name three" + " " * 60 + "name").otherwise("a name and name")
    docs = rows.select(key.alias("doc_id"), body.alias("text"))
    given = rows.select(key.alias("doc_id"), F.lit("name").alias("text"), F.lit("PER").alias("entity_type"), F.lit(3).alias("start"), F.lit(7).alias("end"))
    return spans.refit(given, docs).select("doc_id", "start", "end")


@query("SELECT c_custkey, 'a &lt;b&gt; <del>old</del><ins>new &amp; ' || c_custkey || '</ins>' AS html FROM customer")
def difference_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    ops = F.array(op("equal", F.lit("a <b> ")), op("del", F.lit("old")), op("ins", F.concat(F.lit("new & "), F.col("c_custkey").cast("string"))))
    return read(spark, sf_dir, "customer").select("c_custkey", diff.diff_html(ops).alias("html"))


@query("SELECT o_orderkey AS doc_id, 'del' AS kind, 'old' AS text, 4 AS start, 5 + length(CAST(o_orderkey AS VARCHAR)) AS at FROM orders UNION ALL SELECT o_orderkey, 'ins', 'x' || o_orderkey, 4, 4 FROM orders")
def change_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where deletions and insertions stand in their own text and in the other; what comes stands before what goes."""
    rows = read(spark, sf_dir, "orders")
    pairs = rows.select(F.col("o_orderkey").alias("doc_id"), F.lit("the old end").alias("old"), F.concat(F.lit("the x"), F.col("o_orderkey").cast("string"), F.lit(" end")).alias("new"))
    got = diff.mutations(diff.word_diff(pairs))
    return got.select("doc_id", "kind", "text", F.col("start").cast("int").alias("start"), F.col("at").cast("int").alias("at"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.n_tokens(F.col("text")).alias("tokens"))


@query(
    """WITH d AS (SELECT DISTINCT o_orderkey % 50 AS doc, o_orderpriority AS k, o_orderstatus AS t FROM orders WHERE o_custkey % 3 > 0), g AS (SELECT DISTINCT o_orderkey % 50 AS doc, o_orderpriority AS k, o_orderstatus AS t FROM orders WHERE o_custkey % 3 < 2),
    j AS (SELECT coalesce(d.doc, g.doc) AS doc, d.doc IS NOT NULL AND g.doc IS NOT NULL AS tp, g.doc IS NULL AS fp, d.doc IS NULL AS fn FROM d FULL JOIN g ON d.doc = g.doc AND d.k = g.k AND d.t = g.t), c AS (SELECT doc, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j GROUP BY 1)
    SELECT CAST(doc AS VARCHAR) AS doc, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each document; texts are matched by their keys, types by name."""
    rows = read(spark, sf_dir, "orders")
    side = lambda test, tail: rows.where(test).select((F.col("o_orderkey") % 50).cast("string").alias("doc"), F.concat("o_orderpriority", F.lit(tail)).alias("text"), F.col("o_orderstatus").alias("entity_type"))
    return evaluate.document_f1(evaluate.compare(side("o_custkey % 3 > 0", " ;"), side("o_custkey % 3 < 2", ""))).select("doc", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(x[CAST(floor(0.95 * (n + 1)) AS INT)] + (x[CAST(floor(0.95 * (n + 1)) AS INT) + 1] - x[CAST(floor(0.95 * (n + 1)) AS INT)]) * (0.95 * (n + 1) - floor(0.95 * (n + 1))), 6) AS p95 FROM events, (SELECT list_sort(list(value)) AS x, count(*) AS n FROM events) GROUP BY x, n")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latencies(read(spark, sf_dir, "events"), "value").select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (doc_id % 2 = 0) AS round_trips, count(*) AS spans, count(*) FILTER (lang = 'en') AS english FROM documents")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.col("lang").alias("entity_type"), F.lit("regex").alias("source_layer"))
    out = evaluate.corpus_summary(found, docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).alias("exact")))
    return out.select("documents", "characters", "round_trips", "spans", F.try_element_at("by_entity_type", F.lit("en")).alias("english"))


@query("SELECT doc_id, length(text) AS characters, CAST(doc_id % 3 AS BIGINT) AS spans FROM documents")
def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("i")).where("i > 0").select("doc_id", F.lit("PER").alias("entity_type"), F.lit("ner").alias("source_layer"))
    return evaluate.document_rows(docs, found).select("doc_id", "characters", "spans")


@query("SELECT o_orderkey AS doc_id, ['PER', 'ORG', 'MON', 'SHIP'][o_orderkey % 4 + 1] AS entity_type, CASE WHEN o_custkey % 10 / 10.0 >= 0.7 THEN 'ner' ELSE 'ner' END AS source_layer FROM orders WHERE o_custkey % 10 / 10.0 >= 0.5")
def zero_shot_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("Person", "organization", "сумма контракта", "ship"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("x").alias("text"), label.alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end"), (F.col("o_custkey") % 10 / 10).alias("score"))
    return recognize.from_model(rows).select("doc_id", "entity_type", "source_layer")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'llm' ELSE 'ner' END AS source_layer, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS start FROM orders")
def verified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a model's answer holds spans they take the place of a document's own; where it is malformed those stay."""
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders")
    docs = rows.select(key.alias("doc_id"), F.lit("a name").alias("text"))
    own = rows.select(key.alias("doc_id"), F.lit("a").alias("text"), F.lit("PER").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.8).cast("double").alias("score"), F.lit("ner").alias("source_layer"), F.lit("m").alias("recognizer"))
    answer = F.when(key % 2 == 0, '{"verified": [{"text": "name", "entity_type": "PER", "start": 0, "end": 4, "score": 0.9}]}').otherwise("{no json")
    return models.verify(own, docs, rows.select(key.alias("doc_id"), answer.alias("answer"))).select("doc_id", "source_layer", "start")


_PEOPLE = "u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'dn' || c_custkey END AS dn, 'User' || c_custkey AS name FROM customer)"


@query(
    f"""WITH {_PEOPLE} SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 4 = 0 THEN 'by dn' WHEN user_id % 4 = 1 THEN 'by name' ELSE 'old' END AS email FROM u
    UNION ALL SELECT 'ldap:new' || c_custkey, 'added' FROM customer WHERE c_custkey % 10 = 0"""
)
def directory_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users matched with a directory by name in it, else by user name in any case; unknown ones are added."""
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    string = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    users = rows.select(key.cast("string").alias("user_id"), string("User", key).alias("username"), F.when(key % 4 == 0, string("dn", key)).alias("ldap_dn"), F.lit("old").alias("email"), F.lit("x").alias("display_name"), F.lit(True).alias("is_active"))
    entry = lambda test, dn, name, email: rows.where(test).select(dn.alias("dn"), name.alias("username"), F.lit(email).alias("email"), F.lit("y").alias("display_name"))
    directory = entry("c_custkey % 4 = 0", string("dn", key), string("other", key), "by dn").union(entry("c_custkey % 4 = 1", string("late", key), string("USER", key), "by name")).union(entry("c_custkey % 10 = 0", string("new", key), string("fresh", key), "added"))
    return stores.sync_directory(users, directory).select("user_id", "email")


@query("WITH RECURSIVE m AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 24 UNION SELECT n_nationkey FROM nation, m WHERE n_nationkey = k - 1 OR n_nationkey = k // 2) SELECT 'n' || k AS member FROM m WHERE k < 24")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members through two dozen levels of groups in groups."""
    rows = read(spark, sf_dir, "nation").where("n_nationkey > 0")
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("int").cast("string"))
    groups = rows.select(name(k).alias("group"), name(k - 1).alias("member")).union(rows.select(name(k), name(F.floor(k / 2))))
    return stores.members(groups, "n24")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_partkey ELSE 'usual' END AS label FROM part")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/runs/a-b-c-x"), key, F.lit(".json"))).otherwise(F.lit("/runs/plain.json"))
    return read(spark, sf_dir, "part").select("p_partkey", evaluate.run_label(path, F.lit("usual")).alias("label"))


@query("SELECT 's' || p_partkey AS stem, '/f/s' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.docx' ELSE '.txt' END AS document, '/f/s' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_entities.json' ELSE '_ground_truth.json' END AS truth FROM part WHERE p_partkey % 5 > 0")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their expected spans: DOCX before text, ground truth before stored spans; a file without the other is left out."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part")
    file = lambda test, tail: rows.where(test).select(F.concat(F.lit("/f/s"), key.cast("string"), F.lit(tail)).alias("path"))
    files = file("true", ".txt").union(file("p_partkey % 2 = 0", ".docx")).union(file("p_partkey % 5 > 0", "_entities.json")).union(file("p_partkey % 5 > 0 AND p_partkey % 3 > 0", "_ground_truth.json"))
    return evaluate.fixture_pairs(files)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 3 END AS bytes FROM events")
def decoded_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.when(F.col("event_id") % 4 == 0, "no base64!").otherwise("YWJj")
    return stores.screenshots(read(spark, sf_dir, "events").select("event_id", shot.alias("screenshot"))).select("event_id", F.octet_length("screenshot").alias("bytes"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, ['PER', 'ORG'][l_partkey % 2 + 1] AS t FROM lineitem), b AS (SELECT * FROM s WHERE l_linenumber % 2 = 1), a AS (SELECT * FROM s WHERE l_linenumber % 3 = 0) SELECT l_orderkey AS doc_id, l_linenumber AS start FROM b WHERE t = 'ORG' OR l_linenumber % 3 = 0 UNION ALL SELECT l_orderkey, l_linenumber FROM a WHERE l_linenumber % 2 = 0")
def reviewed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted removals go from the spans, accepted suggestions that are not there come in."""
    kind = F.element_at(F.array(F.lit("PER"), F.lit("ORG")), (F.col("l_partkey") % 2 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 1).cast("int").alias("end"), kind.alias("entity_type"), F.lit("x").alias("text"))
    base = rows.where("start % 2 = 1")
    return spans.apply_review(base, base.where("entity_type = 'PER' AND start % 3 > 0"), rows.where("start % 3 = 0")).select("doc_id", "start")


@query("SELECT n_nationkey AS session_id, 2 AS placeholders, n_nationkey % 2 = 0 AS one FROM nation")
def fuzzy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with few differences share a placeholder; others, and numbers, do not."""
    key = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation")
    near = F.when(key % 2 == 0, "Ivanov Petr Petrovitch").otherwise("Ivanova Anna Sergeevna")
    span = lambda t, at: F.struct(t.alias("text"), F.lit("PER").alias("entity_type"), F.lit(at).alias("start"), F.lit(at + 5).alias("end"))
    given = rows.select(key.alias("session_id"), key.alias("doc_id"), F.inline(F.array(span(F.lit("Ivanov Petr Petrovich"), 0), span(near, 50), span(F.lit("Ivanova Anna Sergeevna"), 90))))
    out, _ = registry.placeholders(given, fuzzy=True)
    first = Window.partitionBy("session_id")
    rows = out.withColumn("p", F.max(F.when(F.col("start") == 0, F.col("placeholder"))).over(first)).withColumn("q", F.max(F.when(F.col("start") == 50, F.col("placeholder"))).over(first))
    return rows.groupBy("session_id").agg(F.count_distinct("placeholder").cast("int").alias("placeholders"), F.bool_and(F.col("p") == F.col("q")).alias("one"))
