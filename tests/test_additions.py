"""Operators on documents, stores and results against plain versions."""

import datetime as dt
import io
import json
import os
import random
import statistics
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstream.functions.declension import forms
from veilstream.operators import analytics, chunks, diff, evaluate, filters, models, pipeline, recognize, registry, restore, spans, stores
from veilstream.plans import golden
from veilstream.sources import documents
from veilstream.streaming import stateful

W = documents.W


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(documents._docx(["x"]))) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename == "word/document.xml":
                data = f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'.encode()
            new.writestr(info, data)
    return out.getvalue()


def run(*texts, bold=False):
    return "".join(f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{t}</w:t></w:r>' for t in texts)


def test_declension():
    assert forms("заказчик", "nom gen ins +nom +gen") == ["заказчик", "заказчика", "заказчиком", "заказчики", "заказчиков"]
    assert forms("исполнитель", "gen ins +nom +gen") == ["исполнителя", "исполнителем", "исполнители", "исполнителей"]
    assert forms("продавец", "nom gen ins +dat") == ["продавец", "продавца", "продавцом", "продавцам"]
    assert forms("заявка", "nom gen acc ins +ins") == ["заявка", "заявки", "заявку", "заявкой", "заявками"]
    assert forms("сторона", "gen +gen +ins") == ["стороны", "сторон", "сторонами"]
    assert forms("положение", "nom pre ins +gen") == ["положение", "положении", "положением", "положений"]
    assert forms("застрахованный", "gen fnom +gen") == ["застрахованного", "застрахованная", "застрахованных"]
    assert forms("получающий", "ins fgen") == ["получающим", "получающей"]
    assert set(golden.ROLE_FORMS) <= set(filters.ROLES)


def test_surnames_stay(spark):
    """A surname that is a form of a role is no stop word, alone or with a first name; forms that texts use are."""
    assert len(golden.SURNAMES) >= 50
    rows = [(n, k) for s in golden.SURNAMES for n in (s, f"{s} Пётр") for k in ("PER", "ORG", "LOC")]
    df = spark.createDataFrame(rows, "text string, entity_type string")
    assert [tuple(r) for r in filters.flag_stopwords(df).where("stop and entity_type = 'PER'").collect()] == []
    roles = spark.createDataFrame([(w[0].upper() + w[1:], "PER") for w in golden.ROLE_FORMS], "text string, entity_type string")
    assert filters.flag_stopwords(roles).where("not stop").count() == 0


def test_windows_hold_what_later_steps_look_at(spark):
    """A span stands where its surroundings say; a long text with many spans passes."""
    marked = [golden.text(m) for m in golden.MARKED]
    docs = spark.createDataFrame(list(enumerate(marked)), "doc_id long, text string")
    for r in recognize.matches(docs).collect():
        whole, at = marked[r.doc_id], r.at
        assert whole[at : at + len(r.body)] == r.body and r.body[r.start : r.end] == r.text
        assert at == max(0, at + r.start - recognize.SIDE)
    big = "\n".join(f"сумма 1 {k % 1000:03d} руб. по письму k{k}@example.ru и {'слово ' * 12}" for k in range(25_000))
    one = spark.createDataFrame([(1, big)], "doc_id long, text string")
    found = recognize.extract_spans(one)
    assert len(big) > 2_500_000 and found.count() == 50_000
    assert all(big[r.start : r.end] == r.text for r in found.where("start % 97 = 0").collect())


def test_needs_leave_nothing_out(spark):
    docs = spark.createDataFrame([(i, golden.text(m)) for i, m in enumerate((*golden.MARKED, golden.LAYERS))], "doc_id long, text string")
    bare = [recognize.Recognizer(r.name, r.entity_type, r.pattern, r.score, r.group, r.flags, r.check) for r in recognize.RUSSIAN]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(recognize.extract_spans(docs)) == key(recognize.extract_spans(docs, bare))
    assert sum(bool(r.needs) for r in recognize.RUSSIAN) > 10


def test_deep_scan(spark):
    body = "Встречались Ломов и Климова в городе Омск. Заказчик не пришёл."
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    row = lambda t, k, state=None: (1, t, k, body.index(t), body.index(t) + len(t), 0.8, "ner", "m", state)
    shape = "doc_id long, text string, entity_type string, start int, end int, score double, source_layer string, recognizer string, state string"
    current = spark.createDataFrame([row("Ломов", "PER", "accepted"), row("Заказчик", "PER", "pending"), row("городе", "LOC", "rejected")], shape)
    missed = spark.createDataFrame([(1, "Климова", "PER", 3, 5, 0.8, "llm", "l", None), (1, "Омск", "LOC", 0, 4, 0.8, "llm", "l", None), (1, "нет", "PER", 0, 3, 0.8, "llm", "l", None), row("Ломов", "PER")], shape)
    new, gone = pipeline.deep_scan(docs, current, missed)
    assert sorted((r.text, r.start) for r in new.collect()) == sorted([("Климова", body.index("Климова")), ("Омск", body.index("Омск"))])
    assert [r.text for r in gone.collect()] == ["Заказчик"]


def test_claims(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(200))) for i in range(8)]
    values = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 5))), f"v{k}") for i in range(8) for k in range(6)]
    want = []
    for i, text in texts:
        taken = set()
        for _, v, name in sorted((x for x in set(values) if x[0] == i and x[1]), key=lambda x: (-len(x[1]), x[1], x[2])):
            at = text.find(v)
            while at >= 0:
                if not taken & set(range(at, at + len(v))):
                    taken |= set(range(at, at + len(v)))
                    want.append((i, v, at))
                at = text.find(v, at + len(v))
    got = spans.claims(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(sorted(set(values)), "doc_id long, text string, name string"))
    assert sorted((r.doc_id, r.text, r.start) for r in got.collect()) == sorted(want)


def test_lemmas_join_declined_names(spark):
    rows = [("s", 1, "Иванова Петра", "PER", 0, 13), ("s", 1, "Иванов Пётр", "PER", 20, 31), ("s", 1, "Иванова", "ORG", 40, 47)]
    given = spark.createDataFrame(rows, "session_id string, doc_id long, text string, entity_type string, start int, end int")

    @F.pandas_udf("string")
    def lemma(words: pd.Series) -> pd.Series:
        return words.map({"иванова": "иванов", "петра": "пётр"}.get).fillna(words)

    assert given.count() == 3
    plain, _ = registry.placeholders(given)
    joined, mapping = registry.placeholders(given, lemma=lemma)
    assert plain.select("placeholder").distinct().count() == 3
    assert {r.text: r.placeholder for r in joined.collect()}["Иванова Петра"] == {r.text: r.placeholder for r in joined.collect()}["Иванов Пётр"]
    assert joined.select("placeholder").distinct().count() == 2
    assert registry.entity_counts(mapping).first().entity_count == 2
    assert {r.form for r in registry.entries(mapping).collect()} >= {"Иванова Петра", "Иванов Пётр", "иванов пётр"}


def test_rewritten_files(spark):
    body = f'<w:p>{run("Mr. ")}{run("Iva", "nov", bold=True)}{run(" paid 500 of 500 000 to Ivanov.")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("Ivanov")}</w:p></w:tc></w:tr></w:tbl>'
    files = spark.createDataFrame([(1, docx(body)), (2, None), (3, b"no zip")], "doc_id long, docx binary")
    values = spark.createDataFrame([(1, "Ivanov", "[PERSON_1]"), (1, "500", "[N]"), (1, "nowhere", "[X]"), (3, "a", "b")], "doc_id long, old string, new string")
    lines = lambda c: [t for _, t in documents.docx_paragraphs(bytes(c))]
    out = {r.doc_id: r for r in documents.rewrite_docx(files, values).collect()}
    assert lines(out[1].docx) == ["Mr. [PERSON_1] paid [N] of 500 000 to [PERSON_1].", "[PERSON_1]"] and (out[1].applied, out[1].skipped) == (2, 1)
    assert out[2].docx is None and bytes(out[3].docx) == b"no zip" and out[3].skipped == 1
    xml = zipfile.ZipFile(io.BytesIO(bytes(out[1].docx))).read("word/document.xml").decode()
    assert xml.count("<w:b />") == 2  # formats stay
    once = documents.rewrite_docx(files, values, "first").where("doc_id = 1").first()
    assert lines(once.docx) == ["Mr. [PERSON_1] paid [N] of 500 000 to Ivanov.", "[PERSON_1]"]
    shown = documents.rewrite_docx(files, values, "highlighted").where("doc_id = 1").first()
    assert lines(shown.docx) == lines(out[1].docx)
    xml = zipfile.ZipFile(io.BytesIO(bytes(shown.docx))).read("word/document.xml").decode()
    assert xml.count("highlight") == 4
    with pytest.raises(ValueError):
        documents.rewrite_docx(files, values, "some")


def test_document_order_and_bundles(spark, tmp_path):
    table = f'<w:tbl><w:tr><w:tc><w:p>{run("a")}</w:p></w:tc><w:tc><w:p>{run("a")}</w:p></w:tc><w:tc><w:p>{run("b")}</w:p></w:tc></w:tr></w:tbl>'
    content = docx(f"<w:p>{run('one')}</w:p>{table}<w:p>{run('two')}</w:p>")
    (tmp_path / "x.docx").write_bytes(content)
    assert documents.read_lines(spark, str(tmp_path)).first().text == "one\na | b\ntwo"
    files = spark.createDataFrame([("k", 2, docx(f"<w:p>{run('late')}</w:p>")), ("k", 1, content)], "bundle string, i int, docx binary")
    joined = documents.append_docx(files, "bundle", "i").first()
    assert [t for t in documents.docx_lines(bytes(joined.docx)) if t.strip()] == ["one", "a | b", "two", "late"]


def test_broken_names_are_joined_whatever_their_number(spark):
    broken = " и ".join(f"ООО\n\n«Альфа {k}\nБета»" for k in range(6))
    got = spark.createDataFrame([(broken,), (None,)], "t string").select(documents.normal_pdf_text(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [" и ".join(f"ООО «Альфа {k} Бета»" for k in range(6)), None]


def test_exact_quantiles(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 19, 20, 100, 1001):
        values = [float(rng.randint(0, 500)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
        p = analytics.percentiles(df, "x").first()
        series = pd.Series(values, dtype=float)
        assert tuple(p) == tuple(round(series.quantile(q)) if n else 0 for q in (0.5, 0.95, 0.99))
        got = evaluate.latencies(df, "x").first()
        if not n:
            assert tuple(got) == (None, None, None)
            continue
        cut = lambda m: statistics.quantiles(values, n=100)[m]
        want = (statistics.median(values), cut(94) if n >= 20 else max(values), cut(98) if n >= 100 else max(values))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def quadratic(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def test_long_differences_are_still_longest():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 60))] for _ in "ab")
        steps = diff._runs(a, b)
        assert "".join(t for k, t in steps if k != "ins") == "".join(a) and "".join(t for k, t in steps if k != "del") == "".join(b)
        assert sum(len(t) for k, t in steps if k == "equal") == quadratic(a, b)
    a, b = ([rng.choice("abcdefgh") for _ in range(4000)] for _ in "ab")
    assert "".join(t for k, t in diff._runs(a, b) if k != "ins") == "".join(a)


def test_top_chunks_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)] + [(999, [0.0] * 4), (1000, None)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(4)
    asked = df.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    a = chunks.top_chunks(asked, df, 5).collect()
    b = chunks.top_chunks(asked, df, 5, block=7).collect()
    shape = lambda x: sorted((r.query_id, r["rank"], r.chunk_id, round(r.similarity, 9)) for r in x)
    assert shape(a) == shape(b)

    def cosine(x, y):
        n = (sum(p * p for p in x) * sum(p * p for p in y)) ** 0.5
        return sum(p * q for p, q in zip(x, y, strict=True)) / n if n else 0.0

    for q, v in [(i, v) for i, v in rows if i % 10 == 0 and v is not None]:
        best = sorted((round(-cosine(v, w), 9) for _, w in rows if w is not None))[:5]
        assert [-s for *_, s in shape([r for r in a if r.query_id == q])] == best


def test_chunks_against_slices(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice(["word ", "end. ", "\n", "longwordwithoutspaces" * 9, " "]) for _ in range(rng.randint(0, 120)))) for i in range(30)]
    got = {}
    for r in chunks.chunk(spark.createDataFrame(texts, "doc_id long, text string"), target=30, overlap=5).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        parts = sorted(got.get(i, []), key=lambda r: r.chunk_id)
        assert [p.chunk_id for p in parts] == list(range(len(parts)))
        covered = set()
        for p, after in zip(parts, [*parts[1:], None], strict=True):
            assert text[p.start : p.end] == p.text and p.end - p.start <= 4 * 35 and p.token_count == max(1, len(p.text) // 4)
            covered |= set(range(p.start, p.end))
            assert after is None or (after.start <= p.end or not text[p.end : after.start].strip()) and p.end - after.start <= 4 * 5
        assert all(k in covered or c.isspace() for k, c in enumerate(text))


def test_stores(spark):
    now = dt.datetime(2025, 1, 1)
    table = spark.createDataFrame([("a", "u", "ru", now, True)], "session_id string, user_id string, locale string, created_at timestamp, models_allowed boolean")
    out = stores.create_session(table, spark.createDataFrame([("v", "en"), ("w", "en")], "user_id string, locale string"), now, models_allowed=False)
    assert out.count() == 3 and out.select("session_id").distinct().count() == 3 and out.where("not models_allowed").count() == 2
    raw = [('{"text": "t", "resolved": [], "unresolved": ["x"]}', '[{"placeholder": "[A_1]", "value": "v"}, {"placeholder": "[B_1]"}]'), ("{broken", "{}"), (None, None), ("[]", "no")]
    got = stores.stored_results(spark.createDataFrame(raw, "result_json string, resolutions_json string")).collect()
    assert [r.result and r.result.text for r in got] == ["t", None, None, None]
    assert [[x.value for x in r.resolutions] for r in got] == [["v"], [], [], []]
    now_ = spark.createDataFrame([("s", 0, "a", "t"), ("r", 0, "b", "t")], "session_id string, n int, name string, text string")
    added = spark.createDataFrame([("s", 0, "c", "t"), ("n", 0, "d", "t")], "session_id string, n int, name string, text string")
    names = lambda df: sorted((r.session_id, r.n, r.name) for r in df.collect())
    assert names(stores.upload(now_, added, "append")) == [("n", 0, "d"), ("r", 0, "b"), ("s", 0, "a"), ("s", 1, "c")]
    assert names(stores.upload(now_, added, "replace")) == [("n", 0, "d"), ("r", 0, "b"), ("s", 0, "c")]
    deep = spark.createDataFrame([(f"g{k}", f"g{k + 1}") for k in range(26)] + [("g26", "anna"), ("g26", "g0")], "group string, member string")
    assert {"anna", "g26"} <= {r.member for r in stores.members(deep, "g0").collect()}


def test_users_keep_their_own_rights(spark):
    users = spark.createDataFrame([("me", "admin", True, "a", "A"), ("x", "user", True, "b", "B")], "user_id string, role string, is_active boolean, email string, display_name string")
    none = None
    changes = [("me", "update", "user", none, none, none), ("x", "create", "user", none, none, none), ("q", "delete", none, none, none, none), ("new", "create", "user", none, "n", none)]
    shape = "user_id string, action string, role string, is_active boolean, email string, display_name string"
    out, refused = stores.change_users(users, spark.createDataFrame(changes, shape), "me")
    assert {(r.user_id, r.role, r.is_active) for r in out.collect()} == {("me", "admin", True), ("x", "user", True), ("new", "user", True)}
    assert {r.user_id: r.error for r in refused.collect()} == {"me": "cannot give up the own admin role", "x": "user exists", "q": "no such user"}
    for change in (("me", "delete", none, none, none, none), ("me", "update", none, False, none, none)):
        out, refused = stores.change_users(users, spark.createDataFrame([change], shape), "me")
        assert refused.count() == 1 and out.count() == 2


def test_labels_of_a_registry_are_scanned(spark):
    mapping = spark.createDataFrame([("s", "[SHIP_1]"), ("s", "[SHIP_2]"), ("s", "[ЛИЦО_1]"), ("s", "odd")], "session_id string, placeholder string")
    labels = restore.registry_labels(mapping)
    assert labels == ("SHIP", "ЛИЦО")
    texts = spark.createDataFrame([("s", 1, "the ship_2 and [SHIP 1]")], "session_id string, doc_id long, text string")
    assert [r.raw.strip() for r in restore.scan(texts, labels).orderBy("i").collect()] == ["ship_2", "[SHIP 1]"]


def test_answers_in_parts(spark):
    requests = spark.createDataFrame([("a", "x y"), ("b", "boom")], "request_id string, prompt string")

    def provider(prompt):
        for word in prompt.split():
            if word == "boom":
                raise RuntimeError("no answer")
            yield word

    parts = stateful.stream_answers(requests, provider)
    assert sorted((r.request_id, r.seq, r.kind, r.content) for r in parts.collect()) == [("a", 0, "text", "x"), ("a", 1, "text", "y"), ("a", 2, "done", None), ("b", 0, "error", "no answer")]
    assert {(r.request_id, r.n, r.whole) for r in models.gathered(parts).collect()} == {("a", 2, "xy"), ("b", 0, None)}


def test_results_and_side_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "PER", "ner"), (1, "PER", "regex"), (1, "ORG", "ner")], "doc_id long, entity_type string, source_layer string")
    rows = evaluate.document_rows(docs, found)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].spans == 3 and got[1].by_entity_type == {"ORG": 1, "PER": 2} and got[2].spans == 0
    summary = evaluate.corpus_summary(found, docs, spark.createDataFrame([(1, True)], "doc_id long, exact boolean"))
    evaluate.write_results(rows, summary, str(tmp_path / "out"))
    report = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/report")).collect())
    assert "| documents | 2 |" in report and '| by_entity_type | {"ORG":1,"PER":2} |' in report
    assert spark.read.json(str(tmp_path / "out/documents")).count() == 2
    sessions = spark.createDataFrame([("s/1", "u", '[{"text": "x"}]', b"zip", None)], "session_id string, user_id string, entities_json string, docx binary, response_docx binary")
    documents.write_side_files(sessions, str(tmp_path / "files"))
    folder = tmp_path / "files" / "s_1"
    assert sorted(os.listdir(folder)) == ["docx.docx", "entities.json", "metadata.json"]
    assert json.loads((folder / "metadata.json").read_text())["user_id"] == "u" and (folder / "docx.docx").read_bytes() == b"zip"


def test_models_that_fail_leave_no_vector(spark):
    def model(texts):
        raise RuntimeError

    assert documents.embed(spark.createDataFrame([(1, "a")], "chunk_id long, text string"), model).first().vector is None


def test_errors_are_appended(spark):
    now = dt.datetime(2025, 1, 1)
    none = spark.createDataFrame([], stores.ERRORS)
    out = stores.append_errors(none, spark.createDataFrame([("boom", "warning", "u"), ("bang", "odd", None), (None, "error", "u")], "message string, severity string, user_id string"), now)
    assert {(r.message, r.severity, r.user_id) for r in out.collect()} == {("boom", "warning", "u"), ("bang", "error", None)}
    assert stores.append_errors(out, spark.createDataFrame([("m",)], "message string"), now).where("severity = 'error'").count() == 2


def test_labels_of_sessions_reach_the_model(spark):
    docs = spark.createDataFrame([(1, "ship here", "a"), (2, "ship here", "b"), (3, "ship here", "c")], "doc_id long, text string, session_id string")
    labels = spark.createDataFrame([("a", ["Vessel"]), ("c", [])], "session_id string, labels array<string>")

    def model(batches):
        for b in batches:
            yield pd.DataFrame([(r.doc_id, "ship", r.labels[0], 0, 4, 0.9) for r in b.itertuples()], columns=["doc_id", "text", "label", "start", "end", "score"])

    assert {(r.doc_id, r.entity_type) for r in models.model_spans(docs, model, labels=labels).collect()} == {(1, "VESSEL"), (2, "PER")}


def test_points_in_pieces(spark):
    pieces = spark.createDataFrame([(1, 0, "abc"), (1, 1, ""), (1, 2, "de")], "doc_id long, seg int, text string")
    points = spark.createDataFrame([(1, k) for k in range(7)], "doc_id long, at int")
    got = {r["at"]: (r.seg, r.local) for r in spans.resolve_offsets(pieces, points).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (2, 0), 4: (2, 1), 5: (2, 2), 6: (None, None)}
