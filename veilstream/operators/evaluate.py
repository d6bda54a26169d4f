"""Precision and recall of span sets, and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators.analytics import at_place, ranks


def match_key(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.btrim(text), r"[:;,.!?-]+\z", "")))


def compare(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc, entity_type, tp, fp, fn): distinct (text, type) of both sides, by one full join on the keys."""
    key = ["doc", "key", "entity_type"]
    a, b = (df.select("doc", match_key(F.col("text")).alias("key"), "entity_type").distinct().withColumn(n, F.lit(1)) for df, n in ((detected, "d"), (truth, "t")))
    rows = a.join(b, key, "full")
    count = lambda test: F.count_if(test)
    return rows.groupBy("doc", "entity_type").agg(count(F.col("d").isNotNull() & F.col("t").isNotNull()).alias("tp"), count(F.col("t").isNull()).alias("fp"), count(F.col("d").isNull()).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """counts (…, tp, fp, fn) with precision, recall and f1: 1, 1 and 0 where there is nothing to divide by."""
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(1.0))
    out = counts.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def sums(counts: DataFrame, *by: str) -> DataFrame:
    return rates(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def document_f1(counts: DataFrame) -> DataFrame:
    """F1 of each document, 0 where nothing was found nor expected."""
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    return sums(counts, "doc").withColumn("f1", F.when(empty, 0.0).otherwise(F.col("f1")))


def latencies(docs: DataFrame, column: str) -> DataFrame:
    """Median, p95 and p99. Quantiles are exclusive (n + 1 divisions); with under 20 (100) values they are the greatest one."""
    n, top = F.max("n"), F.max("value")
    exclusive = lambda p: at_place(F.least(p * (F.col("n") + 1) - 1, F.col("n") - 1.0))
    return ranks(docs, column).agg(at_place(0.5 * (F.col("n") - 1)).alias("p50"), F.when(n >= 20, exclusive(0.95)).otherwise(top).alias("p95"), F.when(n >= 100, exclusive(0.99)).otherwise(top).alias("p99"))


def compare_runs(runs: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """One row for each key of any run, a column for each run, and delta: the last run less the first (null if either lacks it)."""
    sides = [df.select(key, F.col(value).alias(name)) for name, df in runs]
    rows = reduce(lambda a, b: a.join(b, key, "full"), sides)
    return rows.withColumn("delta", F.col(runs[-1][0]) - F.col(runs[0][0]))


def run_label(path: Column, run: Column) -> Column:
    """The fourth part of a file's name, split at dashes, else the run's own name."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.json\z", "")
    return F.coalesce(F.get(F.split(name, "-", 4), F.lit(3)), run)


def fixture_pairs(files: DataFrame) -> DataFrame:
    """(stem, document, truth) from paths: the first kind of document, and ground truth before stored entities."""
    name = F.substring_index("path", "/", -1)
    truth = name.rlike(r"_(?:ground_truth|entities)\.json\z")
    rows = files.select("path", truth.alias("is_truth"), F.regexp_replace(name, r"(?:_(?:ground_truth|entities)\.json|\.(?:docx|pdf|txt))\z", "").alias("stem"), name.alias("name"))
    order = F.when(F.col("name").endswith("_ground_truth.json"), 0).when(F.col("is_truth"), 1).when(F.col("name").endswith(".docx"), 0).when(F.col("name").endswith(".pdf"), 1).otherwise(2)
    known = rows.where(F.col("is_truth") | F.col("name").rlike(r"\.(?:docx|pdf|txt)\z"))
    return known.groupBy("stem").agg(F.min_by(F.when(~F.col("is_truth"), F.col("path")), F.when(~F.col("is_truth"), order)).alias("document"), F.min_by(F.when(F.col("is_truth"), F.col("path")), F.when(F.col("is_truth"), order)).alias("truth")).where("document is not null and truth is not null")


def corpus_summary(spans: DataFrame, docs: DataFrame, round_trips: DataFrame) -> DataFrame:
    """One row: documents, characters, spans, spans by type and by layer, and exact round trips of round_trips (doc_id, exact)."""
    by = lambda c: spans.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(f"by_{c}"))
    total = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.char_length("text")).alias("characters"))
    exact = round_trips.agg(F.count_if("exact").alias("round_trips"))
    n = spans.agg(F.count(F.lit(1)).alias("spans"))
    one = lambda df: df.withColumn("_1", F.lit(1))
    return reduce(lambda a, b: a.join(one(b), "_1"), [n, exact, by("entity_type"), by("source_layer")], one(total)).drop("_1")


def document_rows(docs: DataFrame, spans: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A row for each document: characters, spans, spans by type and by layer, and with counts (compare()) its rates."""
    by = lambda c: spans.groupBy("doc_id", c).count().groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(f"by_{c}"), F.sum("count").alias("spans"))
    rows = docs.select("doc_id", F.char_length("text").alias("characters")).join(by("entity_type"), "doc_id", "left").join(by("source_layer").drop("spans"), "doc_id", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.lit(0)))
    return rows if counts is None else rows.join(document_f1(counts).withColumnRenamed("doc", "doc_id"), "doc_id", "left")


def markdown(row: DataFrame, title: str) -> DataFrame:
    """(value): the columns of a one-row table (corpus_summary()) as a Markdown table, one string."""
    shown = lambda c, t: F.to_json(c) if t.startswith(("map", "array", "struct")) else F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"| {c} | "), F.coalesce(shown(c, t), F.lit("")), F.lit(" |")) for c, t in row.dtypes]
    return row.select(F.concat_ws("\n", F.lit(f"# {title}\n\n| measure | value |\n|---|---|"), *lines).alias("value"))


def write_results(rows: DataFrame, summary: DataFrame, path: str, title: str = "Results") -> None:
    """Rows as JSON lines under path/documents, and the one-row summary as JSON and as Markdown beside them."""
    rows.write.mode("overwrite").json(f"{path}/documents")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    markdown(summary, title).coalesce(1).write.mode("overwrite").text(f"{path}/report")
