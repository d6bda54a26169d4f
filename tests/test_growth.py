"""Operators at sizes where a plain version no longer works, and against the plain version where it does."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstream.operators import analytics, audit, diff, models, registry, restore, stores
from veilstream.plans import catalog
from veilstream.streaming import stateful


def test_both_ways_through_two_texts_agree():
    """The way by furthest points is the way by the whole table, step by step."""
    rng = random.Random(1)
    for _ in range(300):
        x, y = (np.array([rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 50))], np.int64) for _ in "xy")
        assert diff._way_by_points(x, y, diff._furthest(x, y)) == diff._way_by_table(x, y)


def test_long_texts_with_few_changes():
    rng = random.Random(2)
    a = [rng.choice(["a", "b", "word", " ", "the", "of", f"n{rng.randrange(5000)}"]) for _ in range(200_000)]
    b = list(a)
    for _ in range(1000):
        b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
    start = time.time()
    runs = diff._runs(a, b)
    assert time.time() - start < 60
    assert "".join(t for k, t in runs if k != "ins") == "".join(a)
    assert "".join(t for k, t in runs if k != "del") == "".join(b)
    changed = sum(x != y for x, y in zip(a, b, strict=True))
    assert sum(t.count("x") for k, t in runs if k == "ins") <= changed


def test_unlike_texts_take_the_table(monkeypatch):
    monkeypatch.setattr(diff, "POINTS", 10)
    assert diff._furthest(np.arange(9), np.arange(9)[::-1].copy()) is None
    assert "".join(t for k, t in diff._runs(list("abcdefgh"), list("hgfedcba")) if k != "del") == "hgfedcba"


def plain_moves(changes, least=0.82):
    words = lambda t: set(t.split())
    out, gone, come = [], set(), set()
    dels, ins = [c for c in changes if c[2] == "del" and len(words(c[3])) >= 3], [c for c in changes if c[2] == "ins" and len(words(c[3])) >= 3]
    pairs = []
    for d in dels:
        for i in ins:
            a, b = words(d[3]), words(i[3])
            if d[0] == i[0] and (s := len(a & b) / max(len(a), len(b))) >= least:
                pairs.append((-len(d[3]), d[1], -s, i[1], d[0]))
    for _, d, s, i, k in sorted(pairs):
        if (k, d) not in gone and (k, i) not in come:
            gone.add((k, d)), come.add((k, i))
            out.append((k, d, i, round(-s, 9)))
    return sorted(out)


def test_moves_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3):
        for i in range(80):
            base = rng.sample([f"w{j}" for j in range(14)], rng.randint(2, 12))
            rows.append((k, i, rng.choice(["del", "ins"]), " ".join(["the", *base])))
    df = spark.createDataFrame(rows, "doc_id long, i int, kind string, text string")
    assert sorted((r.doc_id, r.d, r.i, round(r.sim, 9)) for r in diff.likely_moves(df).collect()) == plain_moves(rows)
    assert len(plain_moves(rows)) > 10


def test_moves_of_a_large_document(spark):
    """Ten thousand deletions and insertions that share their common words, each with one partner."""
    n = 10_000
    text = F.concat(F.lit("the party shall pay for "), *[x for j in range(9) for x in (F.lit(f" k{j}x"), F.col("i").cast("string"))], F.lit(" and more"))
    gone = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("i")).withColumn("kind", F.lit("del")).withColumn("text", text)
    come = gone.withColumn("kind", F.lit("ins")).withColumn("text", F.concat(text, F.lit(" today"))).withColumn("i", F.col("i") + n)
    got = diff.likely_moves(gone.union(come))
    assert got.where(F.col("i") == F.col("d") + n).count() == n == got.count()


def test_a_log_goes_on(spark, tmp_path):
    """A chain in three batches, of a stream that is stopped between them or of tables with tails, is the chain of all rows."""
    cols = ["id", "what"]
    rows = [(k % 3, k, f"e{k}") for k in range(60)]
    whole = {r.id: (r.prev_hash, r.event_hash) for r in audit.chain(spark.createDataFrame(rows, "day long, id long, what string"), "day", "id", cols, "s").collect()}
    df = spark.createDataFrame(rows, "day long, id long, what string")
    parts = [df.where(f"id between {a} and {b}") for a, b in ((0, 9), (10, 39), (40, 59))]
    log = audit.chain(parts[0], "day", "id", cols, "s")
    for part in parts[1:]:
        log = log.union(audit.chain(part, "day", "id", cols, "s", audit.tails(log, "day", "id")))
    assert {r.id: (r.prev_hash, r.event_hash) for r in log.collect()} == whole
    assert audit.verify(log, "day", "id", cols).where("not linked or not intact").count() == 0
    for n, part in enumerate(parts):
        part.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = stateful.chain_events(stream, "day", "id", cols, "s").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(90), n
    assert {r.id: (r.prev_hash, r.event_hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == whole


def test_shuffled_parts_give_whole_answers(spark, tmp_path):
    """Parts and ends in any order over five batches: the answers that the batch operator gives, and texts in order."""
    rng = random.Random(4)
    rows = [(f"r{a}", n, "text", f"<{a}.{n}>") for a in range(12) for n in range(a)] + [(f"r{a}", a, "error" if a % 5 == 4 else "done", "why" if a % 5 == 4 else None) for a in range(12) if a != 7]
    rows += [("r3", 9, "text", "behind the end"), ("r3", 3, "done", None)]
    rng.shuffle(rows)
    shape = "request_id string, seq long, kind string, content string"
    for n in range(5):
        spark.createDataFrame(rows[n::5], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(shape).parquet(str(tmp_path / "in"))
    query = stateful.gather_answers(stream).writeStream.format("memory").queryName("whole_answers").outputMode("append").trigger(processingTime="1 second").start()
    try:  # a time to live asks for batches on and on, so the query is stopped once all rows are there
        end = time.time() + 90
        while spark.table("whole_answers").count() < 66 + 11 and time.time() < end and query.exception() is None:
            time.sleep(1)
    finally:
        query.stop()
    assert query.exception() is None
    got = spark.table("whole_answers").collect()
    want = {r.request_id: r.whole for r in models.gathered(spark.createDataFrame(rows, shape)).collect()}
    assert {r.request_id: r.content for r in got if r.kind == "done"} == {k: v for k, v in want.items() if v is not None}
    assert {r.request_id for r in got if r.kind == "error"} == {"r4", "r9"}
    for a in range(12):
        assert [r.content for r in got if r.request_id == f"r{a}" and r.kind == "text"] == [f"<{a}.{n}>" for n in range(a)]


def test_a_retry_keeps_what_was_answered(spark):
    docs = spark.createDataFrame([(k, f"p{k}") for k in range(1, 5)], "doc_id long, prompt string").coalesce(1)

    def flaky(batches):
        for b in batches:
            yield b.head(2).assign(answer="x" + b["prompt"].head(2))[["doc_id", "answer"]]
            raise OSError

    assert sorted((r.doc_id, r.answer) for r in models.answers(docs, flaky, tries=2, wait=0).collect()) == [(k, f"xp{k}") for k in range(1, 5)]
    assert sorted((r.doc_id, r.answer) for r in models.answers(docs, flaky, tries=1, wait=0).collect()) == [(1, "xp1"), (2, "xp2"), (3, None), (4, None)]


def test_lemmas_of_long_names(spark):
    @F.pandas_udf("string")
    def lemma(words: pd.Series) -> pd.Series:
        return words.str.lower().str.rstrip("аы")

    long = " ".join(f"слово{k}а" for k in range(1500))
    rows = spark.createDataFrame([("s", 1, long, "PER", 0, 5), ("s", 1, long.replace("а ", "ы "), "PER", 9, 12), ("s", 1, "Вода", "ORG", 20, 24)], "session_id string, doc_id long, text string, entity_type string, start int, end int")
    given, mapping = registry.placeholders(rows, lemma=lemma)
    assert given.select("placeholder").distinct().count() == 2
    assert len(mapping.where("entity_type = 'PER'").first().canonical.split(" ")) == 1500


def test_a_name_that_all_rows_hold_is_dealt_out(spark, monkeypatch):
    """Rows of one value meet its dictionary form in many tasks, and keep what they were."""
    monkeypatch.setattr(registry, "settled", lambda df: df)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 50 == 0, F.concat(F.lit("rare "), F.col("id").cast("string"))).otherwise("anna").alias("canonical"), F.when(F.col("id") % 3 == 0, "ORG").otherwise("PER").alias("entity_type"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = registry.with_lemmas(rows, F.upper)
        assert out.columns == rows.columns
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    plain = {r.id: r.canonical.upper() if r.entity_type == "PER" else r.canonical for r in rows.collect()}
    assert len(got) == 4000 and {r.id: r.canonical for r in got} == plain
    share = [sum(r.canonical == "ANNA" and r.task == k for r in got) for k in range(4)]
    assert max(share) < 0.7 * sum(share)


def test_mentions_are_sorted_in_as_many_tasks_as_spark_shuffles_into(spark, capsys):
    """Long mentions that compress well would come together in a task for each core."""
    rows = spark.range(200).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("имя "), 50).alias("text"), F.lit("PER").alias("entity_type"), F.lit(0).alias("start"), F.lit(5).alias("end"))
    registry.placeholders(rows)[1].explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def folded(values):
    """Values in order: each joins the first earlier entity of its session and type that is close enough."""
    entities, out = [], {}
    for s, v, k, o in sorted(values, key=lambda r: (r[3], r[2], r[1])):
        most = min(len(v) // 4, 4)
        head = next((e for es, e, ek in entities if es == s and ek == k and most and distance(e, v) <= most), None)
        if head is None:
            entities.append((s, v, k))
        out[s, v, k, o] = head or v
    return out


def edited(rng, value, times):
    for _ in range(times):
        at = rng.randrange(len(value) + 1)
        value = rng.choice([value[:at] + rng.choice("abc") + value[at:], value[:at] + value[at + 1 :], value[:at] + rng.choice("abc") + value[at + 1 :]])
    return value


def test_pieces_miss_no_close_pair():
    rng = random.Random(6)
    for _ in range(4000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(3, 24)))
        b = edited(rng, a, rng.randint(0, 5))
        most = min(len(b) // 4, 4)
        if most and a != b and distance(a, b) <= most:
            assert set(registry._kept_pieces(a)) & set(registry._sought_pieces(b)), (a, b)


def test_fuzzy_entities_equal_the_fold(spark):
    """Chains of edited names, several sessions and types, ties of order: as one value after the other would be taken."""
    rng = random.Random(7)
    values = {}
    for s in ("s", "t"):
        for _ in range(6):
            base = "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 20)))
            for _ in range(8):
                base = edited(rng, base, rng.randint(0, 3)) or "x"
                kind = rng.choice(["PER", "ORG"])
                values.setdefault((s, base, kind), f"{rng.randrange(60):05d}")
    rows = [(s, v, k, o) for (s, v, k), o in values.items()]
    df = spark.createDataFrame(rows, "session_id string, canonical string, entity_type string, ord string")
    got = {(r.session_id, r.canonical, r.entity_type, r.ord): r.entity for r in registry.fuzzy_entities(df, ("PER", "ORG")).collect()}
    assert got == folded(rows)
    only = {(r.session_id, r.canonical, r.entity_type): r.entity for r in registry.fuzzy_entities(df, ("PER",)).collect()}
    assert all(e == v for (_, v, k), e in only.items() if k == "ORG")


def test_a_session_of_many_names(spark):
    """Forty thousand names, every other one with a letter more: each pair is one entity."""
    n = 40_000
    name = F.substring(F.md5(F.floor(F.col("id") / 2).cast("string")), 1, 18)
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.when(F.col("id") % 2 == 0, name).otherwise(F.concat(name, F.lit("x"))).alias("canonical"), F.lit("PER").alias("entity_type"), F.format_string("%09d", "id").alias("ord"))
    out = registry.fuzzy_entities(df, ("PER",))
    assert out.count() == n
    assert out.where("entity = canonical").count() == n // 2


def test_quantiles_of_a_hot_day(spark):
    """One day with 99% of the rows: ranks within days are gapless, and quantiles those of numpy."""
    rng = random.Random(8)
    rows = [("a" if k % 100 else rng.choice(["b", None]), rng.choice([None, float(rng.randrange(50)), rng.random()])) for k in range(5000)]
    df = spark.createDataFrame(rows, "day string, ms double").repartition(6)
    got = analytics.ranks(df, "ms", "day").collect()
    for day in ("a", "b", None):
        values = sorted(v for d, v in rows if d == day and v is not None)
        mine = sorted((r["rank"], r.value) for r in got if r.day == day)
        assert mine == list(enumerate(values))
        assert {r.n for r in got if r.day == day} == {len(values)}
        place = analytics.at_place(F.lit(0.95) * (F.col("n") - 1))
        found = analytics.ranks(df, "ms", "day").where(F.col("day").eqNullSafe(day)).groupBy("day").agg(place.alias("p")).first().p
        assert abs(found - np.percentile(values, 95)) < 1e-9


def test_two_directory_entries_for_one_user(spark):
    """The entry of the user's own dn holds, else that of the least dn, in whatever order they come."""
    users = spark.createDataFrame([("u1", "Anna", "dn9", None, None), ("u2", "Ivan", None, None, None)], "user_id string, username string, ldap_dn string, email string, display_name string")
    entries = [("dn1", "anna", "a1", "A1"), ("dn9", "other", "a9", "A9"), ("dn3", "IVAN", "i3", "I3"), ("dn2", "ivan", "i2", "I2"), ("dn7", "new", "n", "N")]
    for some in (entries, entries[::-1]):
        out = stores.sync_directory(users, spark.createDataFrame(some, "dn string, username string, email string, display_name string").repartition(2))
        assert sorted((r.user_id, r.ldap_dn, r.email) for r in out.collect()) == [("ldap:dn7", "dn7", "n"), ("u1", "dn9", "a9"), ("u2", "dn2", "i2")]


@pytest.mark.parametrize("name", ["golden_spans", "likely_moves", "line_filters", "anonymize_restore"])
def test_texts_are_not_sent_through_the_driver(spark, name, capsys):
    """Spark takes texts put together from columns for short and would broadcast them, however many there are."""
    catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert "Broadcast" not in capsys.readouterr().out


def plain_target(normalized, known, language):
    """The placeholder of known that a normalized one means, by trying all of them one after the other."""
    cut = lambda p: (p[1:-1].rpartition("_")[0], p[1:-1].rpartition("_")[2])

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    name, number = cut(normalized)
    other = (restore._EN_RU if language == "ru" else restore._RU_EN).get(name)
    names = [name] + ([other] if other else [])
    for n in names:
        if f"[{n}_{number}]" in known:
            return f"[{n}_{number}]"
    for n in names:
        near = [(edits(n, cut(p)[0]), p) for p in known if cut(p)[1] == number]
        near = [(d, p) for d, p in near if d <= min(2, min(len(n), len(cut(p)[0])) // 4)]
        if near:
            return min(near)[1]
    return None


@pytest.mark.parametrize("language", ["ru", "en"])
def test_placeholders_mean_what_trying_all_gives(spark, language):
    rng = random.Random(5)
    names = [*restore.LABELS[:12], "PERSAN", "PERSONS", "ADRESS", "PROJECTS", "PROJECT", "PROJEKT"]
    known = {s: {f"[{rng.choice(names)}_{rng.randint(1, 3)}]" for _ in range(rng.randint(0, 25))} for s in "abcdef"}
    shape = "session_id string, placeholder string, canonical string, entity_type string, original_forms array<string>, surface_forms array<string>"
    mapping = spark.createDataFrame([(s, p, f"{s}{p}", "X", [], [f"{s}{p}0", f"{s}{p}1"][: rng.randint(0, 2)]) for s, ps in known.items() for p in sorted(ps)], shape)
    asked = [(s, d, " ".join(f"[{rng.choice(names)}_{rng.randint(1, 4)}]" for _ in range(rng.randint(0, 30)))) for s in "abcdefg" for d in range(4)]
    texts = spark.createDataFrame(asked, "session_id string, doc_id long, text string")
    back, found = restore.restore(texts, mapping, language=language)
    forms = {(r.session_id, r.placeholder): r.surface_forms for r in mapping.collect()}
    want, out = [], {}
    for s, d, text in asked:
        met, words = {}, []
        for i, raw in enumerate(text.split()):
            p, n = plain_target(raw, known.get(s, ()), language), met.setdefault(raw, 0)
            met[raw] += 1
            value = None if p is None else (forms[s, p][n] if n < len(forms[s, p]) else f"{s}{p}")
            want.append((s, d, i, p or "", n, value or ""))
            words.append(value or raw)
        out[s, d] = " ".join(words)
    assert sorted((r.session_id, r.doc_id, r.i, r.placeholder or "", r.occurrence, r.value or "") for r in found.collect()) == sorted(want)
    assert {(r.session_id, r.doc_id): r.text for r in back.collect()} == out


@pytest.mark.parametrize("name", ["distorted_placeholders", "manually_restored", "anonymize_restore"])
def test_texts_are_searched_for_placeholders_once(spark, name, capsys):
    """What is found and resolved is read again, not worked out again: for the texts, the resolutions and what is asked of the mapping."""
    catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all" not in plan
    assert name == "anonymize_restore" or plan.count("Exchange hashpartitioning") <= 8


def test_moves_are_shuffled_once(spark, capsys):
    """A change is shuffled as its text, not as a row for each of its words."""
    catalog.queries()["likely_moves"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "explode" not in plan


def test_moves_of_many_documents(spark, monkeypatch):
    """Documents of one change, without a key, without a text and of many changes, over the borders of batches."""
    monkeypatch.setattr(diff, "MOVES_AT_ONCE", 3)
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["del", "ins"]), " ".join(rng.sample([f"w{j}" for j in range(9)], rng.randint(1, 9)))) for k in range(60) for i in range(rng.choice([1, 2, 9, 40]))]
    extra = [(None, 1, "del", "a b c"), (None, 2, "ins", "a b c"), (1, 99, "ins", None), (1, 98, "equal", "a b c d")]
    df = spark.createDataFrame(rows + extra, "name long, i int, kind string, text string")
    assert sorted((r.name, r.d, r.i, round(r.sim, 9)) for r in diff.likely_moves(df, "name").collect()) == plain_moves(rows)
