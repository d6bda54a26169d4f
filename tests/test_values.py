import random
import re

from veilstream.functions import values
from veilstream.operators import registry, spans


def plain_claims(body, wanted):
    taken, out = [False] * len(body), []
    for k in values.longest_first(wanted):
        at = body.find(wanted[k]) if wanted[k] else -1
        while at >= 0:
            if not any(taken[at : at + len(wanted[k])]):
                taken[at : at + len(wanted[k])] = [True] * len(wanted[k])
                out.append((k, at))
            at = body.find(wanted[k], at + len(wanted[k]))
    return out


def plain_replace(body, pairs):
    applied = 0
    for old, new in pairs:
        head, tail = (r"(?<!\d)" if old[0].isdigit() else ""), (r"(?!\s*\d)" if old[-1].isdigit() else "")
        changed = re.sub(head + re.escape(old) + tail, lambda _, new=new: new, body, flags=re.ASCII)
        applied += changed != body
        body = changed
    return body, applied


def test_claims_and_replacements_equal_plain_loops():
    draw = random.Random(7)
    passes = 0
    for letters, news in (("ab", ["[X_1]", "[Y]", "[]"]), ("a12 ", ["[X_1]", "[2]", "<>"]), ("ab1 ", ["a", "", " z", "b1", "[Q]"]), ("12 ", ["7", "[1", "_"])):
        for _ in range(3000):
            body = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
            wanted = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 5))]
            assert values.claimed(body, wanted) == plain_claims(body, wanted)
            pairs = sorted({(w, draw.choice(news)) for w in wanted}, key=lambda p: (-len(p[0]), p))
            assert values.replaced(body, pairs) == plain_replace(body, pairs), (body, pairs)
            passes += len(pairs) > 1 and not values._meet(pairs)
    assert passes > 3000  # most of them by the one pass


def test_values_within_their_own_new_ones():
    """A placeholder that holds the value it stands for does not bring back a pass over the text for each value."""
    draw = random.Random(8)
    passes = 0
    for letters in ("12 ", "a12 ", "123"):
        for _ in range(3000):
            body = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
            wanted = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 5))}
            pairs = sorted(((w, draw.choice(["[N_%s]", "<%s 1>", "[%s]"]) % w) for w in wanted), key=lambda p: (-len(p[0]), p))
            assert values.replaced(body, pairs) == plain_replace(body, pairs), (body, pairs)
            passes += len(pairs) > 1 and not values._meet(pairs)
    assert passes > 3000
    keys = [str(10 * k + 3) for k in range(20_000)]
    pairs = [(k, f"[N_{k}]") for k in sorted(keys, key=lambda k: (-len(k), k))]
    assert not values._meet(pairs)
    assert values.replaced("; ".join(f"{k} of 99999999{k}" for k in keys), pairs) == ("; ".join(f"[N_{k}] of 99999999{k}" for k in keys), len(keys))


def test_whole_words_without_case():
    draw = random.Random(3)
    for _ in range(3000):
        body = "".join(draw.choice("аАбИ -_1") for _ in range(draw.randint(0, 25)))
        wanted = ["".join(draw.choice("аАби ") for _ in range(draw.randint(1, 3))) for _ in range(3)]
        plain = [(k, m.start()) for k, w in enumerate(wanted) for m in re.finditer(rf"(?<![\w-]){re.escape(w)}(?![\w-])", body, re.I)]
        assert values.whole(body, wanted) == plain, (body, wanted)
    assert values.whole("ſtraße İx STRASSE straße", ["STRAßE"]) == [(0, 0), (0, 18)]  # letters are folded one for one


def test_five_thousand_values_in_a_megabyte():
    import time

    wanted = [f"Лицо {i} Иванов" for i in range(5000)]
    body = " и ".join(wanted * 11)
    pairs = sorted(((w, f"[PER_{i}]") for i, w in enumerate(wanted)), key=lambda p: (-len(p[0]), p))
    start = time.time()
    text, applied = values.replaced(body, pairs)
    assert applied == 5000 and "Иванов" not in text and text.count("[PER_") == 55_000
    assert len(values.claimed(body, wanted)) == 55_000
    assert time.time() - start < 20 and len(body) > 1_000_000


def test_claims_of_null_and_empty(spark):
    texts = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, "ab"), (1, ""), (1, None), (2, "ab"), (3, "x"), (9, "ab")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.start, r.end) for r in spans.claims(texts, wanted).collect()) == [(1, "ab", 0, 2), (1, "ab", 3, 5)]


def test_values_are_not_collected_into_rows(spark, capsys):
    """Neither Spark nor a batch holds a list of a text's values; texts of one id, null ones and null ids are as they were."""
    docs = spark.createDataFrame([(1, "10 of 100, 10"), (1, "10"), (2, None), (3, "10"), (None, "10")], "doc_id long, text string")
    given = [(1, "10", "[A]"), (1, "10", "[A]"), (1, "100", "[B]"), (2, "10", "[A]"), (None, "10", "[A]"), (9, "10", "[A]"), (3, "", "[A]"), (3, "10", None)]
    done = registry.substitute_by_value(docs, spark.createDataFrame(given, "doc_id long, old string, new string"))
    assert sorted((r.doc_id or 0, r.text or "", r.applied, r.skipped) for r in done.collect()) == [(0, "10", 0, 0), (1, "[A]", 1, 1), (1, "[A] of [B], [A]", 2, 0), (2, "", 0, 1), (3, "10", 0, 0)]
    done.explain()
    assert "collect_" not in capsys.readouterr().out
