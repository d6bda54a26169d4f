"""Sources, stores, audit, comparison and streams."""

import datetime as dt
import io
import time
import zipfile

from pyspark.sql import functions as F

from veilstream.operators import audit, diff, evaluate, models, stores
from veilstream.sources import documents as sources
from veilstream.streaming import stateful

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in more.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_read_documents(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc><w:tc>{p('cell')}</w:tc><w:tc>{p('other')}</w:tc></w:tr></w:tbl>"
    (tmp_path / "a.txt").write_bytes("привет \xff".encode("latin-1", "replace") + b"\xff")
    (tmp_path / "b.docx").write_bytes(docx(p("one") + p(" ") + table + p("two")))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.docx").write_bytes(docx(p("x"), **{"..__evil": "x"}))
    (tmp_path / "e.rtf").write_bytes(b"x")
    got = {r.path[-5:]: r for r in sources.read_documents(spark, str(tmp_path)).collect()}
    assert got["b.docx"[-5:]] is not None
    by = {r.path.rsplit("/", 1)[1]: r for r in sources.read_documents(spark, str(tmp_path)).collect()}
    assert by["b.docx"].text == "one\ntwo" and by["a.txt"].text.endswith("\ufffd")
    assert by["c.docx"].error.startswith("422") and by["d.docx"].error == "422: unsafe paths" and by["e.rtf"].error.startswith("415")
    tables = {r.path.rsplit("/", 1)[1]: r.text for r in sources.read_documents(spark, str(tmp_path / "b.docx"), include_tables=True).collect()}
    assert tables["b.docx"] == "one\ntwo\ncell\ncell\nother"
    rows = sources.paragraphs(spark, str(tmp_path / "b.docx"))
    assert sources.table_rows(rows).first()["text"].endswith("cell | other")
    pdf = sources.read_documents(spark, str(tmp_path / "a.txt"), pdf=lambda c: ("t", 1, False, []))
    assert pdf.count() == 1


def test_docx_sink_and_scrub(spark):
    docs = spark.createDataFrame([(1, "one <&>\ntwo\fthree")], "doc_id long, text string")
    content = bytes(sources.to_docx(docs).first()["docx"])
    assert [t for _, t in sources.docx_paragraphs(content) if t.strip()] == ["one <&>", "two", "three"]
    dirty = docx('<w:p w:author="Someone" w:date="2024"><w:r><w:t>x</w:t></w:r></w:p>', docProps__core="<a><b>Someone</b></a>", **{"docProps__core.xml": "<a><b>Someone</b></a>"})
    row = sources.scrub(spark.createDataFrame([(1, dirty), (2, None)], "doc_id long, docx binary")).orderBy("doc_id").first()
    with zipfile.ZipFile(io.BytesIO(bytes(row["docx"]))) as z:
        assert b"Someone" not in z.read("word/document.xml") + z.read("docProps/core.xml")
    assert row["removed"]["attributes"] == 2


def test_pdf_text(spark):
    df = spark.createDataFrame([('ООО\n«Северный\nВетер»  \r\n\r\n\r\n\r\nадрес дом Банк: X',)], "t string")
    assert df.select(sources.normal_pdf_text(F.col("t")).alias("t")).first()["t"] == "ООО «Северный Ветер»\n\nадрес дом\nБанк: X"
    pages = spark.createDataFrame([(1, 1, "a", None), (1, 2, " ", b"img"), (1, 3, "", None)], "doc_id long, page int, text string, image binary")
    read = sources.join_pages(sources.ocr_pages(pages, lambda image: "seen")).first()
    assert read.text == "a\nseen\n" and read.ocr_used and read.page_count == 3 and len(read.warnings) == 1


def test_directory_and_members(spark):
    users = spark.createDataFrame([("u1", "Anna", True, "cn=a", None, None), ("u2", "Boris", True, None, None, None)], "user_id string, username string, is_active boolean, ldap_dn string, email string, display_name string")
    directory = spark.createDataFrame([("cn=a", "anna2", "a@x", "A"), ("cn=b", "BORIS", "b@x", "B"), ("cn=c", "carl", "c@x", "C")], "dn string, username string, email string, display_name string")
    got = {r.username: (r.email, r.ldap_dn) for r in stores.sync_directory(users, directory).collect()}
    assert got == {"Anna": ("a@x", "cn=a"), "Boris": ("b@x", "cn=b"), "carl": ("c@x", "cn=c")}
    groups = spark.createDataFrame([("admins", "g1"), ("g1", "g2"), ("g2", "anna"), ("g2", "g1"), ("x", "boris")], "group string, member string")
    assert {r.member for r in stores.members(groups, "admins").collect()} == {"g1", "g2", "anna"}


def test_nested_redaction_and_broken_chain(spark):
    rows = spark.createDataFrame([(1, '{"a": {"Token": "x", "b": [{"PWD": 1, "c": 2}]}}'), (2, "not json"), (3, None)], "id long, payload string")
    got = [r.payload for r in audit.redact_json(rows).orderBy("id").collect()]
    assert got == ['{"a": {"Token": "[REDACTED]", "b": [{"PWD": "[REDACTED]", "c": 2}]}}', None, None]
    log = audit.chain(spark.createDataFrame([(1, k, f"e{k}") for k in range(5)], "day long, id long, what string"), "day", "id", ["id", "what"])
    forged = log.withColumn("what", F.when(F.col("id") == 2, "forged").otherwise(F.col("what")))
    assert {r.id for r in audit.verify(forged, "day", "id", ["id", "what"]).where("not intact").collect()} == {2}
    cut = audit.verify(log.where("id <> 2"), "day", "id", ["id", "what"]).where("not linked").collect()
    assert [r.id for r in cut] == [3]
    assert audit.verify(log.where("id >= 2"), "day", "id", ["id", "what"]).where("not linked or not intact").count() == 0


def test_evaluation_edges(spark):
    none = spark.createDataFrame([("a", 0, 0, 0)], "doc string, tp long, fp long, fn long")
    assert tuple(evaluate.rates(none).first())[-3:] == (1.0, 1.0, 1.0)
    assert evaluate.document_f1(none).first()["f1"] == 0.0
    few = spark.createDataFrame([(float(i),) for i in range(1, 11)], "ms double")
    assert tuple(evaluate.latencies(few, "ms").first()) == (5.5, 10.0, 10.0)
    many = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    assert tuple(round(x, 2) for x in evaluate.latencies(many, "ms").first()) == (50.5, 95.95, 99.99)


def test_diff_and_moves(spark):
    df = spark.createDataFrame([(1, "Hello big world, ok.", "Hello small <b> world, ok!"), (2, None, "a"), (3, "same", "same")], "doc_id long, old string, new string")
    out = diff.word_diff(df)
    html = {r.doc_id: r.h for r in out.select("doc_id", diff.diff_html(F.col("ops")).alias("h")).collect()}
    assert html[1] == "Hello <ins>small &lt;b&gt;</ins><del>big</del> world, ok<ins>!</ins><del>.</del>" and html[2] == "<ins>a</ins>" and html[3] == "same"
    changes = diff.mutations(out).where("doc_id = 1").orderBy("i").collect()
    assert [(c.kind, c.start, c.at) for c in changes][:2] == [("ins", 6, 6), ("del", 6, 15)]
    moved = spark.createDataFrame([(1, 0, "del", "1. the buyer pays for all goods within ten days"), (1, 1, "ins", "2. the buyer pays for all the goods within ten days"), (1, 2, "ins", "unrelated words stand here")], "doc_id long, i int, kind string, text string")
    assert [(r.d, r.i) for r in diff.likely_moves(moved).collect()] == [(0, 1)]


def test_models(spark):
    docs = spark.createDataFrame([(1, "a name b"), (2, "c")], "doc_id long, text string")

    def model(batches):
        for b in batches:
            yield b.assign(label="person", start=2, end=6, score=[0.9 if i == 1 else 0.2 for i in b["doc_id"]])[["doc_id", "text", "label", "start", "end", "score"]].assign(text="name")

    assert [(r.doc_id, r.entity_type) for r in models.model_spans(docs, model).collect()] == [(1, "PER")]
    assert models.model_spans(docs, None).collect() == []

    def broken(batches):
        raise OSError

    assert [r.answer for r in models.answers(docs.withColumnRenamed("text", "prompt"), broken, tries=2, wait=0).collect()] == [None, None]


def run(writer, tmp_path):
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()


def test_streams_agree_with_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    attempts = [("ip", f"u{k % 2}", at + dt.timedelta(seconds=20 * k), k, k % 11 == 10) for k in range(60)]
    df = spark.createDataFrame(attempts, "ip string, username string, ts timestamp, attempt_id long, success boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(stateful.limit_logins(stream).writeStream.format("memory").queryName("logins").outputMode("append"), tmp_path)
    got = {r.attempt_id: (r.failures, r.blocked) for r in spark.table("logins").collect()}
    assert got == {r.attempt_id: (r.failures, r.blocked) for r in audit.login_blocks(df).collect()}


def test_answers_are_gathered(spark, tmp_path):
    parts = spark.createDataFrame([("a", 0, "text", "x"), ("a", 1, "text", "y"), ("a", 2, "done", None), ("b", 0, "text", "z")], "request_id string, seq long, kind string, content string")
    parts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "in"))
    query = stateful.gather_answers(stream).writeStream.format("memory").queryName("answers").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while spark.table("answers").count() < 4 and time.time() < end and query.exception() is None:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted((r.request_id, r.kind, r.content) for r in spark.table("answers").collect()) == [("a", "done", "xy"), ("a", "text", "x"), ("a", "text", "y"), ("b", "text", "z")]


def test_events_are_appended_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d), "e") for d in (1, 1, 2)], "timestamp timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    query = stateful.append_events(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert {r.date: r.n for r in spark.read.json(str(tmp_path / "log")).groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n")).collect()} == {"2024-01-01": 2, "2024-01-02": 1}


def test_streamed_placeholders(spark, tmp_path):
    rows = [("s", k, name, "PERSON") for k, name in enumerate(("ivan", "pyotr", "ivan", "anna"))] + [("t", 9, "anna", "PERSON")]
    df = spark.createDataFrame(rows, "session_id string, seq long, canonical string, label string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stateful.stream_placeholders(stream).writeStream.format("memory").queryName("placed").outputMode("append").trigger(processingTime="1 second").start()
    try:  # state with a time to live asks for further batches on and on, so the query is stopped once all rows are there
        end = time.time() + 90
        while spark.table("placed").count() < len(rows) and time.time() < end and query.exception() is None:
            time.sleep(1)
    finally:
        query.stop()
    assert query.exception() is None
    got = {(r.session_id, r.seq): r.placeholder for r in spark.table("placed").collect()}
    assert got == {("s", 0): "[PERSON_1]", ("s", 1): "[PERSON_2]", ("s", 2): "[PERSON_1]", ("s", 3): "[PERSON_3]", ("t", 9): "[PERSON_1]"}


def test_audit_chain_goes_by_batches(spark):
    """A hot partition passes through in batches of a few rows, and its chain is that of plain Python."""
    import hashlib

    rows = [(None if k % 7 == 0 else k % 3, k, f"e{k}") for k in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = audit.chain(spark.createDataFrame(rows, "day long, id long, what string").repartition(3), "day", "id", ["id", "what"], "s")
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no frame of a whole group
        got = {r.id: (r.day, r.prev_hash, r.event_hash) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last, want = {}, {}
    for day, k, what in rows:
        prev = last.get(day, "s")
        last[day] = hashlib.sha256(f'{prev}{{"id":{k},"what":"{what}"}}'.encode()).hexdigest()
        want[k] = (day, prev, last[day])
    assert got == want


def test_bundle_digests_without_whole_texts(spark):
    """The digests are those of combine(), and no row of a plan holds a bundle's texts."""
    from pyspark.sql import functions as F

    from veilstream.sources import documents

    rows = [("a", 2, " two "), ("a", 1, "one\n"), ("a", 3, " "), ("b", 4, " alone "), ("c", 5, None), ("d", 6, ""), ("d", 7, None), (None, 8, "x"), (None, 9, "é")]
    parts = spark.createDataFrame(rows, "bundle string, doc_id long, text string").repartition(3)
    parts = parts.select("*", F.col("doc_id").alias("page_count"), F.lit(False).alias("ocr_used"), F.lit(None).cast("array<string>").alias("warnings"))
    want = documents.combine(parts, "bundle", "doc_id").select("bundle", F.sha2("text", 256).alias("sha"), "page_count")
    out = documents.combined_digests(parts, "bundle", "doc_id")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
