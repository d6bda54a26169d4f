"""Span algebra, registry and restoration against plain versions."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstream.functions import fixed
from veilstream.operators import registry, restore, spans

RANK = {t: p for t, _, _, p, _ in fixed.ENTITY_TYPES}
SHAPE = "doc_id long, text string, entity_type string, start int, end int, score double"


def plain_resolution(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[3], -r[5], -(r[4]), r[2])):
        if not kept or r[3] >= kept[-1][4]:
            kept.append(r)
        else:
            rank = lambda x: (RANK.get(x[2], 0), x[5] >= 0.9, x[5], x[4] - x[3])
            if rank(r) > rank(kept[-1]):
                kept[-1] = r
    return kept


def test_overlaps_like_the_fold(spark):
    rng = random.Random(1)
    rows = []
    for doc in range(60):
        for _ in range(rng.randint(1, 25)):
            start = rng.randrange(120)
            rows.append((doc, "t", rng.choice(["MON", "PER", "ORG", "LOC", "OTHER"]), start, start + rng.randint(1, 20), rng.choice([0.4, 0.7, 0.9, 0.95])))
    rows = list(dict.fromkeys(rows))
    got = sorted(tuple(r) for r in spans.resolve_overlaps(spark.createDataFrame(rows, SHAPE)).select(*[c.split()[0] for c in SHAPE.split(", ")]).collect())
    assert got == sorted(x for d in range(60) for x in plain_resolution([r for r in rows if r[0] == d]))


def test_adjacent_persons(spark):
    body = "Петрова, Алексея Николаевича и Иван ООО Пётр"
    rows = [(1, w, k, body.index(w), body.index(w) + len(w), s, body[body.index(w) + len(w) :][:3]) for w, k, s in (("Петрова", "PER", 0.5), ("Алексея", "PER", 0.9), ("Николаевича", "PER", 0.6), ("Иван", "PER", 0.6), ("ООО", "ORG", 0.6), ("Пётр", "PER", 0.6))]
    got = spans.merge_adjacent_persons(spark.createDataFrame(rows, SHAPE + ", tail string")).orderBy("start").collect()
    assert [(r.text, r.score) for r in got] == [("Петрова, Алексея Николаевича", 0.9), ("Иван", 0.6), ("ООО", 0.6), ("Пётр", 0.6)]


def test_refit_and_segments(spark):
    docs = spark.createDataFrame([(1, "aaa name bbb name"), (2, "one token here")], "doc_id long, text string")
    moved = spark.createDataFrame([(2, "token", "X", 6, 11, 0.5), (1, "name", "X", 6, 10, 0.5)], SHAPE)
    assert {r.doc_id: r.start for r in spans.refit(moved, docs).collect()} == {2: 4, 1: 6}
    pieces = spans.segments(spark.createDataFrame([(1, "name", "X", 4, 8, 0.5), (1, "me b", "Y", 6, 10, 0.5)], SHAPE), docs).where("doc_id = 1").orderBy("i").collect()
    assert [(p.text, p.entity_type) for p in pieces] == [("aaa ", None), ("name", "X"), (" bbb name", None)]


def given_spans(spark, rows):
    return spark.createDataFrame(rows, "session_id string, doc_id long, text string, entity_type string, start int, end int")


def test_numbering_and_sharing(spark):
    rows = [("s", 1, "Иван", "PER", 0, 4), ("s", 1, "Пётр", "PER", 10, 14), ("s", 1, "ИВАН", "PER", 20, 24), ("s", 1, "01.01.2024", "DATE", 30, 40), ("s", 1, "02.01.2024", "RU_DATE", 50, 60)]
    for numbering, want in (("reverse", {"Иван": 1, "Пётр": 2}), ("forward", {"Иван": 1, "Пётр": 2})):
        out, mapping = registry.placeholders(given_spans(spark, rows), numbering=numbering)
        got = {r.text: r.placeholder for r in out.collect()}
        assert got["Иван"] == got["ИВАН"] == f"[ЛИЦО_{want['Иван']}]" and got["Пётр"] == f"[ЛИЦО_{want['Пётр']}]"
        assert {got["01.01.2024"], got["02.01.2024"]} == {"[ДАТА_1]", "[ДАТА_2]"}
        forms = {r.placeholder: (r.original_forms, r.surface_forms) for r in mapping.collect()}
        assert forms[got["Иван"]][1] == ["Иван", "ИВАН"]


def test_fuzzy_is_for_names_only(spark):
    rows = [("s", 1, "Николаевна", "PER", 0, 10), ("s", 1, "Николаевне", "PER", 20, 30), ("s", 1, "7707083893", "RU_INN", 40, 50), ("s", 1, "7707083894", "RU_INN", 60, 70)]
    exact = {r.text: r.placeholder for r in registry.placeholders(given_spans(spark, rows))[0].collect()}
    fuzzy = {r.text: r.placeholder for r in registry.placeholders(given_spans(spark, rows), fuzzy=True)[0].collect()}
    legacy = {r.text: r.placeholder for r in registry.placeholders(given_spans(spark, rows), legacy_fuzzy=True)[0].collect()}
    assert exact["Николаевна"] != exact["Николаевне"] and fuzzy["Николаевна"] == fuzzy["Николаевне"]
    assert fuzzy["7707083893"] != fuzzy["7707083894"] and legacy["7707083893"] == legacy["7707083894"]


def test_organizations_lose_forms(spark):
    rows = spark.createDataFrame([("ООО «Аорта»", "ORG"), ("Аорта", "ORG"), ("ООО", "ORG")], "t string, k string")
    assert [r.c for r in rows.select(registry.canonical(F.col("t"), F.col("k")).alias("c")).collect()] == ["аорта", "аорта", "ооо"]
    assert rows.select(registry.canonical(F.col("t"), F.col("k"), whole_words=False).alias("c")).first()["c"] == "рта"


def test_sealed_mapping_opens_only_with_its_key(spark):
    _, mapping = registry.placeholders(given_spans(spark, [("s", 1, "Иван", "PER", 0, 4), ("t", 2, "Пётр", "PER", 0, 4)]))
    sealed = registry.seal(mapping, b"a" * 32)
    assert sealed.count() == 2 and "Иван".encode() not in bytes(sealed.first()["sealed"])
    assert sorted(r.canonical for r in registry.unseal(sealed, b"a" * 32).collect()) == ["иван", "пётр"]
    assert registry.unseal(sealed, b"b" * 32).collect() == []


def test_distorted_forms(spark):
    raw = ["[ЛИЦО_1]", "ЛИЦО 1", "[лицо-01]", "[PERSON_1]", "[ЛИЦОО_1]", "[ОРГАНИЗАЦЫЯ_2]", "[АФТА_1]", "[ЛИЦО_7]", "[Проект X_3]"]
    mapping = spark.createDataFrame(
        [("s", "[ЛИЦО_1]", "иван", "PER", ["Иван"], ["Ивана", "Ивану"]), ("s", "[ОРГАНИЗАЦИЯ_2]", "вектор", "ORG", ["Вектор"], []), ("s", "[ДАТА_1]", "вчера", "DATE", ["вчера"], [])],
        "session_id string, placeholder string, canonical string, entity_type string, original_forms array<string>, surface_forms array<string>",
    )
    texts = spark.createDataFrame([("s", 1, " | ".join(raw))], "session_id string, doc_id long, text string")
    back, found = restore.restore(texts, mapping)
    by_raw = {r.raw: (r.placeholder, r.value) for r in found.collect()}
    assert by_raw["[ЛИЦО_1]"] == ("[ЛИЦО_1]", "Ивана")
    assert by_raw["[ОРГАНИЗАЦЫЯ_2]"] == ("[ОРГАНИЗАЦИЯ_2]", "Вектор")
    assert by_raw["[PERSON_1]"][0] == "[ЛИЦО_1]" and by_raw["[лицо-01]"][1] == "Иван"
    assert by_raw["[АФТА_1]"][1] is None and by_raw["[ЛИЦО_7]"][1] is None
    assert "[ЛИЦО_7]" in back.first()["text"] and "[АФТА_1]" in back.first()["text"]
    assert {r.raw for r in restore.unresolved(found).collect()} >= {"[АФТА_1]", "[ЛИЦО_7]"}
    manual = spark.createDataFrame([("s", "[ЛИЦО_7]", "Некто")], "session_id string, raw string, value string")
    assert "Некто" in restore.restore(texts, mapping, manual)[0].first()["text"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="xyz \n😀", min_size=0, max_size=6), st.text(alphabet="ИванПётр", min_size=1, max_size=5)), min_size=1, max_size=6))
def test_substitution_and_restoration_are_inverse(spark, parts):
    text, rows = "", []
    for k, (plain, name) in enumerate(parts):
        text += plain
        rows.append(("s", 1, name, "PER", len(text), len(text) + len(name)))
        text += name
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out, mapping = registry.placeholders(given_spans(spark, rows), language="en")
    hidden = registry.substitute(docs, out).withColumn("session_id", F.lit("s"))
    back, _ = restore.restore(hidden, mapping, language="en", strict=True)
    assert back.first()["text"] == text
