"""Recognizers, checks, filters and policy on small texts."""

import pytest
from pyspark.sql import functions as F

from veilstream.functions import checksums, text
from veilstream.operators import filters, pipeline, policy, recognize


def found(spark, *texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.entity_type, r.text, r.score) for r in recognize.extract_spans(docs, **options).collect())


def kinds(spark, body):
    return {(k, t) for _, k, t, _ in found(spark, body)}


@pytest.mark.parametrize(
    ("function", "valid", "invalid"),
    [
        (checksums.inn_10, ["7707083893", "7728168971"], ["7707083894", "770708389", "77070838931", "abcdefghij", "", None]),
        (checksums.inn_12, ["500100732259"], ["500100732258", "50010073225"]),
        (checksums.ogrn, ["1027700132195"], ["1027700132196", "102770013219"]),
        (checksums.ogrnip, ["304500116000157"], ["304500116000158"]),
        (checksums.snils, ["11223344595", "00100199800"], ["11223344596", "1122334459"]),
    ],
)
def test_check_digits(spark, function, valid, invalid):
    rows = spark.createDataFrame([(v, True) for v in valid] + [(v, False) for v in invalid], "v string, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", function(F.col("v"))).collect())


def test_structured_identifiers(spark):
    body = "ИНН 7707083893, КПП: 770701001, ОГРН 1027700132195, СНИЛС 112-233-445 95, БИК 044525225, счёт 40817810099910004312, паспорт 4509 123456, тел. +7 (916) 123-45-67, почта a.b@mail.ru"
    want = {
        ("RU_INN", "7707083893"), ("RU_KPP", "770701001"), ("RU_OGRN", "1027700132195"), ("RU_SNILS", "112-233-445 95"), ("RU_BIK", "044525225"),
        ("RU_BANK_ACCOUNT", "40817810099910004312"), ("RU_PASSPORT", "4509 123456"), ("RU_PHONE", "+7 (916) 123-45-67"), ("EMAIL_ADDRESS", "a.b@mail.ru"),
    }
    assert want <= kinds(spark, body)


def test_checks_set_scores(spark):
    scores = {t: s for _, _, t, s in found(spark, "x 7707083893 y", "x 7707083894 y", "ИНН 7707083894", "x 00000000000 z", "x 09940000000000000000 z")}
    assert scores["7707083893"] == 1.0
    assert 0.3 <= scores["7707083894"] < 1.0
    assert "09940000000000000000" not in scores


def test_labelled_values(spark):
    assert ("PER", "Карелина ОЛЬГА АЛЕКСАНДРОВНА") in kinds(spark, "ФИО:\nКарелина ОЛЬГА АЛЕКСАНДРОВНА\n")
    assert ("RU_POLICY_NUMBER", "AB-123456/78") in kinds(spark, "Номер полиса: AB-123456/78")
    assert ("RU_DATE", "15.03.2026") in kinds(spark, "от 15.03.2026 г.")
    assert ("RU_DATE", "25 января 2026") in kinds(spark, "25 января 2026 г.")
    assert ("RU_CASE_NUMBER", "А40-12345/2026") in kinds(spark, "дело А40-12345/2026")
    assert ("RU_CONTRACT_NUMBER", "№ ТЛ-2026/047") in kinds(spark, "Договор № ТЛ-2026/047")
    assert ("ADDR", "101000, г. Москва, ул. Мира, д. 5") in kinds(spark, "Юридический адрес: 101000, г. Москва, ул. Мира, д. 5\n")
    assert any(k == "ORG" and t.startswith("ООО «Ромашка»") for k, t in kinds(spark, "ООО «Ромашка»"))
    assert ("ORG", "Acme Trading Ltd.") in kinds(spark, "by Acme Trading Ltd. today")


def test_money_and_percent(spark):
    assert ("MON", "1 500 000 руб.") in kinds(spark, "цена 1 500 000 руб. всего")
    assert ("MON", "5 %") in kinds(spark, "вознаграждение 5 % от суммы")
    assert not any(k == "MON" for k, _ in kinds(spark, "НДС 20 % сумма"))
    assert not any(k == "MON" for k, _ in kinds(spark, "рост на 20 % за год"))


def test_no_text(spark, docs=None):
    assert found(spark, None, "", "   ") == []


def rows(spark, *spans):
    """Spans given as (body, value, type[, recognizer])."""
    data = [(i, v, k, b.index(v), b.index(v) + len(v), 0.8, "ner", r[0] if r else "m", b) for i, (b, v, k, *r) in enumerate(spans)]
    return spark.createDataFrame(data, "doc_id long, text string, entity_type string, start int, end int, score double, source_layer string, recognizer string, body string")


def test_stop_words(spark):
    stop = ["Заказчиком", "Поставщик/Подрядчика", "Генерального директора", "Заявки Заказчика", "сотрудникам", "ChatGPT", "ИП", "№"]
    keep = ["Петров Иван", "Вектор", "Новосибирск"]
    df = spark.createDataFrame([(v, "PER", True) for v in stop] + [(v, "PER", False) for v in keep] + [("Приложение №2", "ORG", True), ("выписка из реестра", "ORG", True), ("интернет", "LOC", True)], "text string, entity_type string, want boolean")
    assert [(r.text, r.stop) for r in filters.flag_stopwords(df).collect() if r.stop != r.want] == []


def test_title_and_line_filters(spark):
    df = rows(
        spark,
        ("ДИСТРИБУЦИЯ\n№ ТЛ-1/22 от 01.02.2024", "ДИСТРИБУЦИЯ", "ORG"),
        ("Вектор\nпишет письмо", "Вектор", "ORG"),
        ("8 (495) 123-45-67 Москва", "Москва", "LOC"),
        ("живёт в городе Москва", "Москва", "LOC"),
        ("Круглосуточно:\n8 (495) 123-45-67", "8 (495) 123-45-67", "RU_PHONE"),
        ("звонить 8 800 123-45-67", "8 800 123-45-67", "RU_PHONE"),
        ("звонить 8 (916) 123-45-67", "8 (916) 123-45-67", "RU_PHONE"),
    )
    out = filters.with_facts(df).select("doc_id", filters.document_title().alias("t"), filters.after_phone().alias("l"), filters.public_phone().alias("p"))
    got = {r.doc_id: (r.t, r.l, r.p) for r in out.collect()}
    assert [i for i, g in got.items() if g[0]] == [0]
    assert [i for i, g in got.items() if g[1]] == [2]
    assert sorted(i for i, g in got.items() if g[2]) == [4, 5]


def test_invalid_spans(spark):
    df = rows(spark, ("БИК 12345", "12345", "RU_BIK"), ("в 10 дней", "10 дней", "RU_DATE"), ("валюта USD", "USD", "ORG"), ("сумма 500", "500", "MON"), ("номер 500", "500", "MON"), ("ИНН 7707083893", "7707083893", "RU_INN"))
    assert [r.doc_id for r in df.where(filters.invalid()).orderBy("doc_id").collect()] == [0, 1, 2, 4]
    grouped = rows(spark, ("цена 100 000", "100 000", "RU_CONTRACT_NUMBER"), ("№ 100 000", "100 000", "RU_CONTRACT_NUMBER"))
    assert [r.doc_id for r in grouped.where(filters.money_as_contract()).collect()] == [0]


def test_policy(spark):
    cases = [
        (("Письмо", "Письмо", "EMAIL_ADDRESS"), "auto", "structured_type"),
        (("от ООО «Вектор Плюс» всем", "ООО «Вектор Плюс»", "ORG"), "auto", "strong_organization_signal"),
        (("Адвокатское бюро «Ковалёв»", "Адвокатское бюро «Ковалёв»", "ORG"), "auto", "strong_organization_signal"),
        (("полис ДМС Вектор", "Вектор", "ORG"), "ignore", "weak_org_in_public_or_policy_text"),
        (("директор: Кузьма", "Кузьма", "PER"), "auto", "person_context"),
        (("полис и Пульсар", "Пульсар", "PER"), "ignore", "weak_single_token_person"),
        (("город Омск", "Омск", "LOC"), "auto", "location_model_candidate"),
        (("код Х", "код Х", "SECRET_KIND"), "review", "unknown_type_review_only"),
    ]
    got = {r.doc_id: (r.policy_action, r.policy_reason) for r in policy.decide(rows(spark, *[c[0] for c in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [(a, r) for _, a, r in cases]


def test_whole_chain_with_aliases_and_noise(spark):
    body = "ДОГОВОР\n№ 12-А/2026 от 01.02.2026\nООО «Северный Ветер» и Покупатель. Северный Ветер поставит товар на 100 000 руб.\nФИО: Иванов Пётр Сергеевич\n"
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    noise = spark.createDataFrame([(1, "Покупатель", "PER", 0, 10, 0.9, "llm", "m"), (1, "нет такого", "PER", 0, 10, 0.9, "llm", "m")], recognize.SPANS)
    out = pipeline.analyze(docs, extra=noise).collect()
    got = {(r.entity_type, r.text) for r in out}
    assert {("MON", "100 000 руб."), ("PER", "Иванов Пётр Сергеевич"), ("ORG", "Северный Ветер"), ("RU_DATE", "01.02.2026")} <= got
    assert not any(t == "Покупатель" for _, t in got)
    assert any(r.derived_from for r in out)
    assert all(body[r.start : r.end] == r.text for r in out)
    spans = sorted((r.start, r.end) for r in out)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_text_windows(spark):
    body = "first line\nsecond a😀b line\nthird"
    at = body.index("a😀b")
    row = spark.createDataFrame([(body, at, at + 3)], "b string, s int, e int").select(
        text.line(F.col("b"), F.col("s"), F.col("e")).alias("line"), text.lines_with_previous(F.col("b"), F.col("s"), F.col("e")).alias("two"), text.after_line(F.col("b"), F.col("e"), 6).alias("after"), text.around(F.col("b"), F.col("s"), F.col("e"), 2).alias("around")
    ).first()
    assert tuple(row) == ("second a😀b line", "first line\nsecond a😀b line", "\nthird", "d a😀b l")


def test_a_span_is_scored_once(spark, capsys):
    """Context words are looked for once a span, not for its score, for the cutoff and for its layer anew."""
    docs = spark.createDataFrame([(1, "ИНН: 7707083893")], "doc_id long, text string")
    recognize.matches(docs).explain()
    assert capsys.readouterr().out.count("налоговый") == 1


def test_patterns_are_tried_on_texts_that_may_match():
    """Strings that a pattern needs are whole: the beginning of another word does not count."""
    streets = [r for r in recognize.RUSSIAN if "переулок" in r.pattern]
    assert streets and not any(n in "оплатит перед культурой" for r in streets for n in r.needs)
    kinds = {r.entity_type for r in recognize.RUSSIAN if r.needs and any(n in "тел. +7 916 123-45-67, бик 044525225, г. омск, пл. мира, д. 5" for n in r.needs)}
    assert {"RU_PHONE", "RU_BIK", "ADDR"} <= kinds
