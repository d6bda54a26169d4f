import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilstream.llm import hashing, quality_net, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    cover = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


def counts(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_rules_odd(odd, odd_rows, labels):
    assert counts(quality_rules.quality_rules(odd, labels)) == Counter((i, *brute(t)) for i, t in odd_rows)


def test_rules_corpus(docs, labels):
    out = quality_rules.quality_rules(docs, labels)
    assert counts(out) == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert out.where("base_failed and kept").count() == 0
    joined = out.join(labels, "doc_id").where("not base_failed")
    assert joined.where("quality = 1 and not kept").count() <= 0.03 * joined.where("quality = 1").count()


def test_regression_separates_held_back_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = quality_rules.quality_rules(docs, known).join(held, "doc_id").select("quality", "probability").collect()
    good, bad = ([r.probability for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def plain_features(text):
    """Features of a text one by one, by kind."""
    one = lambda w: int(hashing.words([w.encode()])[1][0])
    mix = lambda v: int(hashing.mix(np.array([v % 2**64], np.uint64))[0])
    words = [one(w) for w in WORD.findall(text)]
    yield [h % quality_rules.WIDTH for h in words]
    yield [quality_rules.WIDTH + mix(a + b * int(hashing.STEPS[0])) % quality_rules.WIDTH for a, b in zip(words, words[1:], strict=False)]
    signs = [ord(c) for c in text]
    trio = lambda a, b, c: (((a * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b * 0x85EBCA77) & 0xFFFFFFFF) ^ c) * 2654435761 % 2**32 >> 17
    yield [2 * quality_rules.WIDTH + trio(*t) for t in zip(signs, signs[1:], signs[2:], strict=False)]


def test_verdicts_against_plain_scores(odd, odd_rows, docs, labels):
    """The probability is the calibrated sum of mean weights of words, word pairs and runs of three code points."""
    model = quality_rules.train(docs, labels)
    judged = {r.doc_id: r for r in odd.select("doc_id", "text").mapInArrow(quality_rules._judge(odd.sparkSession.sparkContext.broadcast(model)), quality_rules.RULED).collect()}
    for i, t in odd_rows:
        if i in (3, None) or len(t or "") > 20_000:
            continue
        raw = sum(float(np.mean(model.weight[f])) if f else 0.0 for f in plain_features(t or ""))
        p = 1 / (1 + np.exp(-np.clip(model.a * (raw + model.bias) + model.b, -30, 30)))
        assert abs(judged[i].probability - p) < 1e-6
        assert judged[i].kept == (not brute(t)[-1] and p >= quality_rules.THRESHOLD)


def test_sample_is_bounded_in_features(docs, labels, monkeypatch):
    seen = []
    real = quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda ends, features, values, y: seen.append((len(y), len(features))) or real(ends, features, values, y, 3))
    for entries in (5000, 20_000, 10**9):
        quality_rules.train(docs, labels, entries=entries)
    assert seen[0][1] <= 5000 < seen[1][1] <= 20_000 < seen[2][1] and 0 < seen[0][0] < seen[1][0] < seen[2][0]


def test_contexts_and_pooling_against_loops(spark):
    texts = ["alpha beta beta gamma, alpha!", "Ünï code 123 beta", "", "x"]
    place, sign = quality_net.index_vectors()
    index = np.zeros((quality_net.UNITS, quality_net.DIM))
    for u in range(quality_net.UNITS):
        for p, g in zip(place[u], sign[u], strict=True):
            index[u, p] += g
    want = np.zeros((quality_net.UNITS, quality_net.DIM))
    for t in texts:
        words = quality_net.units([t.encode()])[1][:, 0]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality_net.REACH), min(len(words), i + quality_net.REACH + 1)):
                if i != j:
                    want[w] += index[words[j]]
    assert (quality_net.contexts([t.encode() for t in texts]).reshape(want.shape) == want).all()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    vectors = quality_net.word_vectors(df)
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors, want / np.maximum(length, 1e-6) + index / 2, atol=1e-5)
    pooled = quality_net.pooled([t.encode() for t in texts], vectors)
    for t, got in zip(texts, pooled, strict=True):
        rows = vectors[quality_net.units([t.encode()])[1].ravel()].astype(np.float64)
        plain = np.concatenate((rows.mean(0), rows.std(0))) if len(rows) else np.zeros(2 * quality_net.DIM)
        assert np.allclose(got, plain, atol=2e-3)


def test_empty_tables(empty, spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(empty, none).collect() == []
    assert quality_net.quality_scores(empty, none).collect() == []
    assert {r.score for r in quality_net.quality_scores(docs, none).collect()} == {0.5}


def test_scores_odd(odd, odd_rows, labels):
    rows = quality_net.quality_scores(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_net.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_held_out_labels_are_not_learned(docs, labels):
    turned = labels.withColumn("quality", F.when(quality_net.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_net.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_accepted_keeps_columns(odd, labels):
    out = quality_net.accepted(odd, labels)
    assert out.columns == odd.columns
    scores = quality_net.quality_scores(odd, labels).select("doc_id", "score").collect()
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in scores if r.score >= quality_net.THRESHOLD)


def test_sample_has_one_row_for_an_id(spark):
    """A hundred thousand rows of one labelled id give one row, the same in every order."""
    from veilstream.llm.labelled import labelled_sample

    rows = spark.range(100_000).selectExpr("7L AS doc_id", "concat('text ', id % 50000) AS text").union(spark.createDataFrame([(8, None), (9, "nine"), (9, "nine"), (10, "ten")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1), (9, 0), (11, 1), (None, 1), (10, None)], "doc_id long, quality int")
    one, two = (sorted(tuple(r) for r in labelled_sample(d, labels, 100).collect()) for d in (rows.repartition(5), rows.repartition(2, "text")))
    assert one == two
    assert [r[0] for r in one] == [7, 8, 9]
    assert one[2][1:] == ("nine", 0)
    assert labelled_sample(rows, labels, 2).count() <= 2
