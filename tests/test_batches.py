"""Passes over groups work on batches of many documents, and differences do not pay for numpy on short texts."""

import random
import time

import numpy as np
import pyarrow as pa

from veilstream.operators import diff, models, recognize, spans

SPAN = "doc_id long, text string, entity_type string, start int, end int"


def _passes(monkeypatch, df) -> list:
    """What mapInArrow is given from now on."""
    given, kind = [], type(df)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: given.append((self.schema.names, f)) or real(self, f, *a, **k))
    return given


def test_a_batch_holds_many_documents(spark, monkeypatch):
    """An Arrow batch for each document of one span costs more than the search in it."""
    docs = spark.createDataFrame([(i, f"a b{i} c b{i}") for i in range(5)], "doc_id long, text string")
    rows = spark.createDataFrame([(i, f"b{i}", "PER", 0, 1) for i in range(5)] + [(2, "gone", "PER", 0, 1), (3, "c", "PER", 5, 6)], SPAN)
    given = _passes(monkeypatch, docs)
    moved, claimed, near = spans.realign(rows, docs), spans.claims(docs, rows.select("doc_id", "text")), recognize.with_surroundings(rows, docs)
    values = [[{"text": f"b{i}", "entity_type": "PER", "start": 0, "end": 1}] for i in range(5)]
    columns = {"doc_id": pa.array(range(5), pa.int64()), "document_profile": pa.array(["generic"] * 5), "body": pa.array([f"a b{i} c b{i}" for i in range(5)])}
    kinds = [("text", pa.string()), ("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    for (names, run), width, n in zip(given, (4, 1, 4), (5, 10, 5), strict=True):
        columns["s"] = pa.array([[{k: v[k] for k, _ in kinds[:width]} for v in vs] for vs in values], pa.list_(pa.struct(kinds[:width])))
        out = list(run(iter([pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)])))
        assert [o.num_rows for o in out] == [n]
    assert sorted(map(tuple, moved.select("doc_id", "text", "start").collect())) == [(0, "b0", 2), (1, "b1", 2), (2, "b2", 2), (3, "b3", 2), (3, "c", 5), (4, "b4", 2)]
    assert sorted(map(tuple, claimed.select("doc_id", "text", "start").collect())) == sorted([(i, f"b{i}", s) for i in range(5) for s in (2, 7)] + [(3, "c", 5)])
    assert near.count() == 7


def test_places_across_batches(spark, monkeypatch):
    monkeypatch.setattr(spans, "SPANS_AT_ONCE", 3)
    monkeypatch.setattr(recognize, "SPANS_AT_ONCE", 3)
    docs = spark.createDataFrame([(i, "x" * i + "name, name") for i in range(9)], "doc_id long, text string").coalesce(1)
    rows = spark.createDataFrame([(i, "name", "PER", s, s + 4) for i in range(9) for s in (i, i + 6)], SPAN)
    assert sorted(map(tuple, spans.realign(rows, docs).select("doc_id", "start").collect())) == [(i, s) for i in range(9) for s in (i, i + 6)]
    assert sorted(map(tuple, spans.claims(docs, rows.select("doc_id", "text").distinct()).select("doc_id", "start").collect())) == [(i, s) for i in range(9) for s in (i, i + 6)]
    found = recognize.in_text(recognize.with_surroundings(rows, docs)).select("doc_id", "start", "text").collect()
    assert sorted(map(tuple, found)) == [(i, s, "name") for i in range(9) for s in (i, i + 6)]


def test_answers_are_read_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a name"), (2, "a name")], "doc_id long, text string")
    own = spark.createDataFrame([(1, "a", "PER", 0, 1, 0.8, "ner", "m"), (2, "a", "PER", 0, 1, 0.8, "ner", "m"), (None, "a", "PER", 0, 1, 0.8, "ner", "m")], recognize.SPANS)
    told = spark.createDataFrame([(1, '{"verified": [{"text": "name", "entity_type": "PER", "start": 0, "end": 4}]}'), (2, "{no")], "doc_id long, answer string")
    out = models.verify(own, docs, told)
    assert sorted(map(str, out.select("doc_id", "source_layer", "start").collect())) == sorted(map(str, spark.createDataFrame([(1, "llm", 2), (2, "ner", 0), (None, "ner", 0)], "doc_id long, source_layer string, start int").collect()))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_bits_take_the_way_of_the_table():
    rng = random.Random(3)
    for k in range(500):
        x, y = ([rng.randrange(rng.choice([2, 3, 9, 40])) for _ in range(rng.randint(0, 90))] for _ in "xy")
        y = [t for t in x if rng.random() < 0.8] if k % 3 == 0 else y
        assert diff._way_by_bits(x, y) == diff._way_by_table(np.array(x, np.int64), np.array(y, np.int64))


def test_unlike_texts_of_a_few_hundred_words():
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(150)}" for _ in range(250)] for _ in range(200)]
    start = time.process_time()
    for a, b in zip(texts, texts[1:], strict=False):
        diff._runs(a, b)
    assert time.process_time() - start < 1.5


def test_places_of_changes_take_no_shuffle(spark):
    op = "array<struct<kind:string,text:string>>"
    rows = [(i, [("equal", "аб"), ("del", "old"), ("ins", "n😀w"), ("equal", " "), ("ins", "")][: i % 6]) for i in range(12)] + [(99, None)]
    got = diff.mutations(spark.createDataFrame(rows, f"doc_id long, ops {op}"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.where("doc_id = 5").collect())) == [(5, 1, "del", "old", 2, 5, 2), (5, 2, "ins", "n😀w", 2, 5, 5), (5, 4, "ins", "", 6, 6, 6)]
    assert got.count() == 2 * (0 + 0 + 1 + 2 + 2 + 3)


def test_moved_sections_take_one_shuffle_of_digests(spark):
    """Texts of sections stay where they are: what is shuffled holds no text, and neither side is joined."""
    body = lambda n, x="goods": f"{n}. Section {n}\n{n}.1 The party of part {n} delivers {x} and pays for them within thirty days of the invoice date"
    text = lambda *parts: "\n".join(["Preamble 1", *parts])
    old = [(1, text(body(1), body(2), body(3))), (2, text(body(1), body(2))), (3, text(body(1), body(1), body(2))), (4, None), (None, text(body(1), body(2)))]
    new = [(1, text(body(3), body(2), body(1))), (2, text(body(1), body(2))), (3, text(body(2), body(1), body(1))), (4, ""), (None, text(body(2), body(1)))]
    got = diff.moved_blocks(*(spark.createDataFrame(rows, "doc_id long, text string") for rows in (old, new)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got.columns == ["doc_id", "old_block", "old_start", "old_end", "new_block", "new_start", "new_end"]
    n = len(body(1)) + 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 11, 10 + n, 3, 11 + 2 * n, 10 + 3 * n), (1, 3, 11 + 2 * n, 10 + 3 * n, 1, 11, 10 + n)]
