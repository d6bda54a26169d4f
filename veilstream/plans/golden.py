"""Whole texts of the kinds that the engine is for, with the spans that must be found marked in them, and values that must not be.

In MARKED a span is written as {TYPE|value}; texts() gives the plain text and the places of its spans.
"""

from __future__ import annotations

import re

CONTRACT = """ДОГОВОР ПОСТАВКИ
{RU_CONTRACT_NUMBER|№ СВ-2025/118} от {RU_DATE|14.03.2025}

{ORG|ООО «Северный Ветер»}, именуемое далее Поставщик, и {ORG|АО «Балтийские Верфи»}, именуемое далее Покупатель, заключили договор.

1. Цена товара составляет {MON|2 450 000 руб.} и вознаграждение {MON|7,5 %} от суммы поставки.
2. Срок поставки: 15 дней. Товар передаётся {RU_DATE|3 апреля 2025} года.
3. Спор рассматривается между сторонами на основании их взаимного согласия и в порядке, который они выбрали; НДС 20 % уплачивает Покупатель.
4. Спор рассматривается в деле {RU_CASE_NUMBER|А56-1234/2025}.

Юридический адрес: {ADDR|190000, г. Санкт-Петербург, ул. Садовая, д. 7}
ИНН: {RU_INN|7707083893}
КПП: {RU_KPP|770701001}
ОГРН: {RU_OGRN|1027700132195}
БИК: {RU_BIK|044525225}
Расчётный счёт: {RU_BANK_ACCOUNT|40817810099910004312}
Телефон: {RU_PHONE|+7 (912) 345-67-89}
Почта: {EMAIL_ADDRESS|sales@severveter.ru}
ФИО: {PER|Климов Артём Игоревич}
"""

EXTRACT = """ВЫПИСКА ИЗ ЕГРЮЛ
{ORG|Общество с ограниченной ответственностью «Полярная Звезда»}
ОГРНИП: {RU_OGRN|304500116000157}
ИНН предпринимателя: {RU_INN|500100732259}
Дата записи: {RU_DATE|05.06.24}
{ORG|ИП Савельев Пётр Андреевич}
Адрес: {ADDR|344000, г. Ростов-на-Дону, ул. Речная, дом 12}
Исполнитель и Заказчик, Приложение №2
"""

INSURANCE = """Памятка застрахованного по полису ДМС
Застрахованный: {PER|Орлова МАРИЯ ПАВЛОВНА}
Номер полиса: {RU_POLICY_NUMBER|ДМС-445566/77}
СНИЛС {RU_SNILS|112-233-445 95}, паспорт {RU_PASSPORT|4509 123456}
Медицинский пульт круглосуточно:
8 (495) 123-45-67
Бесплатно: 8 800 555-35-35
Личный телефон: {RU_PHONE|8 (903) 765-43-21}
"""

POLICY = """ПОЛОЖЕНИЕ о работе с ИИ-инструментами
Сотрудники {ORG|Адвокатского Бюро «Гранит»} не передают ChatGPT и DeepSeek сведения о доверителях.
Положение подписал директор. Сумма взноса {MON|1 000 (одна тысяча) рублей}.
Работники соблюдают Положение и Памятку, Интернет и облачный ИИ.
Выступление о том, как за год выросло число читателей библиотеки, опубликовано в журнале: рост на 50 % за год.
"""

ENGLISH = """Supply agreement between
{ORG|Harbour Light Trading Co., Ltd.} and {ORG|Northern Mill GmbH}.
The price is {MON|125000 USD} and payment {MON|300 EUR} follows on {RU_DATE|01.09.2025}.
Write to {EMAIL_ADDRESS|office@harbour-light.com}, reference {RU_CONTRACT_NUMBER|N 45-17}.
"""

#: With a model's spans beside the patterns' (EXTRA); some of them must go, and two are one name.
LAYERS = """Письмо о встрече
На встрече были {PER|Климова, Анна Сергеевна} и {PER|Ломов}, приехали из города {LOC|Омск}.
тел. {RU_PHONE|8 (916) 123-45-67} Самара
Говорил представитель Заказчика, валюта USD, срок 10 дней, ответил Claude из компании «Ромб».
"""
EXTRA = (
    ("PER", "Климова"), ("PER", "Анна Сергеевна"), ("PER", "Ломов"), ("LOC", "Омск"), ("LOC", "Самара"), ("PER", "Заказчика"), ("ORG", "USD"),
    ("DATE", "10 дней"), ("PER", "Claude"), ("ORG", "«Ромб»"), ("PER", "нет в тексте"),
)

#: Names that are no stop words.
NAMES = (
    "Петров Иван", "Вектор", "Новосибирск", "Северный Ветер", "Громов", "Алмазный край", "Lindqvist", "Приморье", "Адамантов", "Орион Плюс",
    "Заказчиков Пётр", "Агентство Норд", "Актау", "Договорной Илья", "Контрактский", "Политехник", "Сторонников", "Пультяков", "Директоров",
)

MARKED = (CONTRACT, EXTRACT, INSURANCE, POLICY, ENGLISH)
_MARK = re.compile(r"\{([A-Z_]+)\|([^}]*)\}")


def text(marked: str) -> str:
    return _MARK.sub(lambda m: m[2], marked)


def spans(marked: str) -> list[tuple[str, str, int]]:
    """(type, value, start in the plain text) of each mark."""
    out, shift = [], 0
    for m in _MARK.finditer(marked):
        out.append((m[1], m[2], m.start() - shift))
        shift += len(m[0]) - len(m[2])
    return out


# Words that are never a person, an organization or a place, as they stand in texts; the list that SQL knows.
ROLE_FORMS = (
    "исполнитель", "исполнителя", "исполнителю", "исполнителем", "заказчик", "заказчика", "заказчику", "заказчиком",
    "поставщик", "поставщика", "покупатель", "покупателя", "услугодатель", "услугодателем", "продавец", "продавца",
    "подрядчик", "подрядчика", "субподрядчик", "арендодатель", "арендодателю", "арендатор", "арендатором", "кредитор", "должник",
    "заёмщик", "заемщик", "залогодатель", "залогодержатель", "сторона", "стороны", "сторон", "сторонами",
    "раскрывающая", "раскрывающей", "раскрывающую", "раскрывающим", "получающая", "получающую",
    "третье лицо", "третьи лица", "принципал", "принципалу", "агент", "агента", "агенту", "агентом", "комиссионера", "комитента",
    "лицензиар", "лицензиат", "правообладатель", "грузоотправитель", "грузополучатель", "перевозчик", "экспедитор",
    "сотрудник", "сотруднике", "сотрудники", "сотрудников", "сотрудниках", "работником", "работники", "работников",
    "доверителю", "доверителей", "доверителями", "контрагенту", "контрагентов", "контрагентами", "кандидата", "кандидатов",
    "пользователем", "пользователей", "застрахованный", "застрахованном", "застрахованную", "застрахованных",
    "страхователе", "страхователей", "страховщике", "страховщиков", "страховой", "страховое", "страховым", "страховые",
    "страховая компания", "страховую компанию", "пульт", "пульте", "истец", "ответчик", "заявитель", "участника", "участники",
    "представителем", "представителям", "обвиняемый", "потерпевший", "свидетель", "эксперт", "заявка", "заявки", "заявкой", "заявками",
    "приложение", "приложении", "приложения", "приложением", "дополнение", "акт", "протокол", "накладная", "договор", "контракт", "соглашение",
    "счёт-фактура", "положение", "положения", "положении", "положению", "положением", "политика", "политики", "политике", "политику", "политикой", "памятка", "памятки", "памятке", "памятку", "памяткой", "заявке", "заявку",
    "заключен", "заключён", "заключили", "заключённый",
)

# Surnames that are also forms of such words, or look like them.
SURNAMES = (
    "Агентов", "Должников", "Экспертов", "Кредиторов", "Договоров", "Продавцов", "Поставщиков", "Заказчиков", "Истцов", "Ответчиков",
    "Актов", "Протоколов", "Контрактов", "Пультов", "Ответчикова", "Подрядчиков", "Субподрядчиков", "Заёмщиков", "Перевозчиков",
    "Экспедиторов", "Арендаторов", "Комитентов", "Комиссионеров", "Принципалов", "Лицензиаров", "Лицензиатов", "Агентова", "Экспертова",
    "Должникова", "Договорова", "Продавцова", "Сторонкин", "Сторонников", "Актаев", "Пультяков", "Заявкин", "Накладов", "Протоколова",
    "Приложенцев", "Соглашенский", "Контрактский", "Перевозчикова", "Поставщикова", "Сотников", "Свидетелев", "Кредиторова",
    "Покупателев", "Исполнителев", "Заказчикова", "Заявителев", "Арендаторова", "Истцова", "Положенцев", "Накладнов", "Стороженко",
)
