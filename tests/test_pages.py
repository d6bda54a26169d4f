import random
import time

from pyspark.sql import functions as F

from veilstream.sources import documents as sources

BOX = "doc_id long, page int, n long, x0 double, y0 double, x1 double, y1 double"
LINE = "doc_id long, page int, x0 double, x1 double, y double"


def crossed(c, line):
    (_, _, _, x0, y0, x1, y1), (_, _, a, b, y) = c, line
    w, h = max(x1 - x0, 0.1), max(y1 - y0, 0.1)
    return c[:2] == line[:2] and a - 0.5 <= (x0 + x1) / 2 <= b + 0.5 and 0.32 <= (y - y0) / h <= 0.74 and (min(x1, b) - max(x0, a)) / w >= 0.25


def test_struck_characters_equal_all_pairs(spark):
    draw = random.Random(11)
    chars, lines = [], []
    for n in range(1500):
        x, y, h = draw.uniform(-20, 200), draw.choice([draw.uniform(-50, 300), 8.0 * draw.randint(-3, 20)]), draw.choice([0.0, 0.05, 5, 10, 16, 16.5, 40, 1000, 1e7])
        chars.append((1 + n % 2, 1 + n % 3, n, x, y, x + draw.choice([0, 3, 60]), y + h))
    for _ in range(150):
        x = draw.uniform(-20, 200)
        lines.append((draw.randint(1, 2), draw.randint(1, 3), x, x + draw.uniform(2, 30), draw.choice([draw.uniform(-50, 400), 8.0 * draw.randint(-3, 30)])))
    for c in chars[:60]:  # lines at the very borders of the middle part
        lines.append((c[0], c[1], c[3], c[5] + 2, c[4] + draw.choice([0.32, 0.74, 0.5]) * max(c[6] - c[4], 0.1)))
    got = sources.without_struck(spark.createDataFrame(chars, BOX), spark.createDataFrame(lines, LINE))
    want = {c[2] for c in chars if not any(crossed(c, x) for x in lines)}
    assert {r.n for r in got.collect()} == want and 100 < len(want) < 1450
    odd = [(1, 1, 1, None, 0.0, 1.0, 9.0), (1, 1, 2, 0.0, float("nan"), 1.0, 9.0), (1, None, 3, 0.0, 0.0, 5.0, 10.0), (1, 1, 4, 0.0, 0.0, 5.0, 10.0)]
    got = sources.without_struck(spark.createDataFrame(odd, BOX), spark.createDataFrame([(1, 1, 0.0, 9.0, 5.0), (1, 1, None, 9.0, 5.0), (1, None, 0.0, 9.0, 5.0)], LINE))
    assert {r.n for r in got.collect()} == {1, 2, 3}


def test_a_large_page(spark):
    chars = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("n"), (F.col("id") % 100 * 5.0).alias("x0"), (F.floor(F.col("id") / 100) * 12.0).alias("y0"), (F.col("id") % 100 * 5.0 + 5).alias("x1"), (F.floor(F.col("id") / 100) * 12.0 + 10).alias("y1"))
    lines = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % 10 * 50.0).alias("x0"), (F.col("id") % 10 * 50.0 + 20).alias("x1"), (F.floor(F.col("id") / 10) * 12.0 + 5).alias("y"))
    start = time.time()
    assert sources.without_struck(chars, lines).count() == 60_000  # four of ten
    assert time.time() - start < 60


def test_files_are_read_by_a_page_parser(spark, tmp_path):
    def pages(content):
        word = content.decode()
        if word == "broken":
            raise ValueError(word)
        chars = [{"line": 0, "pos": i, "c": c, "line_x0": 0.0, "x0": 5.0 * i, "y0": 0.0, "x1": 5.0 * i + 5, "y1": 10.0} for i, c in enumerate(word)]
        struck = [{"kind": "line", "x0": 0.0, "y0": 5.0, "x1": 15.0, "y1": 5.0, "color": None}]
        return [{"width": 600.0, "text": word, "chars": chars, "drawings": struck}, {"text": " ", "image": b"scan"}, {"text": ""}][: 0 if word == "none" else 3]

    for name, content in (("a.pdf", "oldnew"), ("b.PDF", "broken"), ("c.pdf", "none"), ("d.txt", "plain"), ("e.xyz", "?")):
        (tmp_path / name).write_text(content)
    got = {r.path.rsplit("/")[-1]: r for r in sources.read_documents(spark, str(tmp_path), pages=pages, ocr=lambda image: image.decode() + "ned").collect()}
    a = got["a.pdf"]
    assert (a.text, a.page_count, a.ocr_used, a.warnings, a.error) == ("new\nscanned\n", 3, True, ["page 3 has no text"], None)
    assert (got["c.pdf"].text, got["c.pdf"].page_count) == ("", 0)
    assert got["b.PDF"].error.startswith("422") and got["e.xyz"].error.startswith("415") and got["d.txt"].text == "plain"
    assert len(got) == 5
