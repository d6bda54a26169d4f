"""Document sources: files to (path, doc_id, text, page_count, ocr_used, warnings, error), and sinks.

Files are read by Spark's binaryFile source; only the parsing of one file's bytes is Python. PDF and OCR parsers are
passed in: none is part of this repository.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions.text import safe_segment
from veilstream.sources.tables import settled

# Limits of archives and uploads, and where a struck character's line may cross it.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 2000, 250 * 1024 * 1024, 100
MOST_UPLOAD = 50 * 1024 * 1024
FORMATS = ("txt", "docx", "pdf")
STRUCK_LOW, STRUCK_HIGH, STRUCK_OVERLAP = 0.32, 0.74, 0.25
#: Height of the smallest bands in which characters and lines meet.
BAND = 8.0
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: What a page parser gives for a page; page numbers are given here, from 1.
LAYOUT = {
    "width": "double", "text": "string", "image": "binary", "chars": "array<struct<line:int,pos:int,c:string,line_x0:double,x0:double,y0:double,x1:double,y1:double>>",
    "drawings": "array<struct<kind:string,x0:double,y0:double,x1:double,y1:double,color:string>>",
}
PAGES = f"array<struct<{','.join(f'{n}:{t}' for n, t in LAYOUT.items())}>>"
PARSED = "text string, page_count int, ocr_used boolean, warnings array<string>, error string"


def archive_error(content: bytes) -> str | None:
    """Why a zip is not opened; None if it is fine."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return "invalid DOCX file"
    names = [i.filename.replace("\\", "/") for i in infos]
    files = [i for i in infos if not i.is_dir()]
    if len(infos) > MOST_ENTRIES:
        return "too many entries"
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        return "unsafe paths"
    if sum(i.file_size for i in files) > MOST_BYTES:
        return "expands to too much data"
    if any(i.compress_size and i.file_size > MOST_RATIO * i.compress_size for i in files):
        return "suspicious compression"
    return None


def _text(p: ElementTree.Element) -> str:
    parts = {f"{W}t": lambda e: e.text or "", f"{W}tab": lambda e: "\t", f"{W}br": lambda e: "\n"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def docx_lines(content: bytes) -> list[str]:
    """Texts of paragraphs and tables in the order of the document; cells of a table row are joined by |, those of equal text once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    out = []
    for part in body:
        if part.tag == f"{W}p":
            out.append(_text(part))
        elif part.tag == f"{W}tbl":
            for row in part.findall(f"{W}tr"):
                cells = ["\n".join(_text(p) for p in cell.findall(f"{W}p")).strip() for cell in row.findall(f"{W}tc")]
                out.append(" | ".join(c for k, c in enumerate(cells) if c and (not k or c != cells[k - 1])))
    return [t for t in out if t.strip()]


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(where, text) of paragraphs: those of the body, then tables row by row with the tables inside them."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")

    def tables(parent: ElementTree.Element, path: str) -> Iterator[tuple[str, str]]:
        for t, table in enumerate(parent.findall(f"{W}tbl")):
            for r, row in enumerate(table.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    at = f"{path}table{t}/row{r}/cell{c}/"
                    yield from ((at, _text(p)) for p in cell.findall(f"{W}p"))
                    yield from tables(cell, at)

    return [("body", _text(p)) for p in body.findall(f"{W}p")] + list(tables(body, ""))


def _parse(kind: str, content: bytes, include_tables: bool, pdf: Callable | None) -> tuple:
    if len(content) > MOST_UPLOAD:
        return None, None, False, [], "413: too large"
    if kind == "txt":
        return content.decode("utf-8", "replace"), None, False, [], None
    if kind == "docx":
        if problem := archive_error(content):
            return None, None, False, [], f"422: {problem}"
        try:
            found = docx_paragraphs(content)
        except (KeyError, ElementTree.ParseError, AttributeError):
            return None, None, False, [], "422: invalid DOCX file"
        return "\n".join(t for where, t in found if t.strip() and (include_tables or where == "body")), None, False, [], None
    if kind == "pdf" and pdf is not None:
        return (*pdf(content), None)
    return None, None, False, [], "415: no parser for this format"


def read_documents(spark: SparkSession, path: str | list[str], include_tables: bool = False, pdf: Callable | None = None, pages: Callable | None = None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """Documents of the files under path. Files that are refused have an error and no text.

    pdf: from a PDF's bytes to (text, page_count, ocr_used, warnings). Or pages: from its bytes to a list of pages as
    dictionaries of LAYOUT, which are composed as in compose_pages(), with ocr for blank ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))

    @F.pandas_udf(PARSED)
    def parse(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [_parse(k, c, include_tables, pdf) for k, c in zip(kinds, contents, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])

    parsed = files.select("path", F.xxhash64("path").alias("doc_id"), parse(kind, "content").alias("p"))
    if pages is None:
        return parsed.select("path", "doc_id", "p.*")

    @F.pandas_udf(PAGES)
    def layout(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        def one(k: str, content: bytes) -> list[dict] | None:
            if k != "pdf" or len(content) > MOST_UPLOAD:
                return None
            try:
                return [{**dict.fromkeys(LAYOUT), **p} for p in pages(content)]
            except Exception:  # whatever an injected parser raises, the file is refused
                return None

        return pd.Series([one(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)

    both = settled(files.select("path", F.xxhash64("path").alias("doc_id"), parse(kind, "content").alias("p"), layout(kind, "content").alias("pages"), (kind == "pdf").alias("is_pdf")))
    plain = both.where("pages is null").select("path", "doc_id", "p.*", "is_pdf")
    failed = F.col("is_pdf") & F.col("error").startswith("415")
    plain = plain.withColumn("error", F.when(failed, "422: invalid PDF file").otherwise(F.col("error"))).drop("is_pdf")
    paths = both.where("pages is not null").select("path", "doc_id")
    composed = paths.join(compose_pages(both.select("doc_id", "pages"), ocr), "doc_id")
    return plain.unionByName(composed.drop("removed").withColumn("error", F.lit(None).cast("string")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of DOCX files with paragraphs and tables in the order of the document; null where a file is refused."""

    @F.pandas_udf("string")
    def parse(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if archive_error(c) else "\n".join(docx_lines(c)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), parse("content").alias("text"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, para_idx, place, text) of each DOCX paragraph, tables included."""

    @F.pandas_udf("array<struct<place:string,text:string>>")
    def parse(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [] if archive_error(c) else [{"place": w, "text": t} for w, t in docx_paragraphs(c)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.posexplode(parse("content")).alias("para_idx", "p")).select("doc_id", "para_idx", "p.*")


def table_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, line): paragraphs in order, cells of a table row joined by | without neighbours of equal text."""
    row = F.regexp_extract("place", r"\A(.*row\d+/)", 1)
    cells = rows.withColumn("_row", F.when(row != "", row).otherwise(F.concat_ws("#", F.lit("p"), "para_idx")))
    got = cells.groupBy("doc_id", "_row").agg(F.min("para_idx").alias("i"), F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]).alias("c"))
    kept = F.filter("c", lambda x, i: (i == 0) | (x != F.get("c", i - 1)))
    lines = got.select("doc_id", "i", F.array_join(kept, " | ").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def combine(parts: DataFrame, bundle: str, order: str) -> DataFrame:
    """One document for each bundle: texts that are not blank, a blank line between them; pages added, warnings joined."""
    text = F.btrim("text", F.lit(" \t\r\n"))
    rows = parts.withColumn("_t", F.when(text != "", text))
    got = rows.groupBy(bundle).agg(
        F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_t").alias("t"))))).alias("t"), F.count(F.lit(1)).alias("n"), F.first("text").alias("only"),
        F.sum("page_count").alias("page_count"), F.bool_or("ocr_used").alias("ocr_used"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("warnings", F.array().cast("array<string>")).alias("w")))), lambda x: x["w"])).alias("warnings"),
    )
    joined = F.array_join(F.transform("t", lambda x: x["t"]), "\n\n")
    return got.select(bundle, F.when(F.col("n") == 1, F.col("only")).otherwise(joined).alias("text"), "page_count", "ocr_used", "warnings")


def combined_digests(parts: DataFrame, bundle: str, order: str) -> DataFrame:
    """(bundle, sha, page_count): the SHA-256 of each text that combine() makes, without building it.

    A bundle's rows pass through a worker in order and in batches, so a bundle may be larger than memory or a row.
    """
    rows = parts.select(F.col(bundle).cast("string").alias("b"), F.col(order).alias("o"), "text", F.btrim("text", F.lit(" \t\r\n")).alias("t"), F.col("page_count").cast("long").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            own = hashlib.sha256(only.encode()).hexdigest() if n == 1 and only is not None else None if n == 1 else sha.hexdigest()
            return pa.RecordBatch.from_pylist([{"bundle": last, "sha": own, "page_count": pages}], pa.schema([("bundle", pa.string()), ("sha", pa.string()), ("page_count", pa.int64())]))

        last, n = None, 0
        for batch in batches:
            for b, text, t, p in zip(*[batch[c] for c in ("b", "text", "t", "p")], strict=True):
                b, t, p = b.as_py(), t.as_py(), p.as_py()
                if n and b != last:
                    yield done()
                    n = 0
                if not n:
                    last, only, sha, some, pages = b, text.as_py(), hashlib.sha256(), False, None
                n += 1
                pages = pages if p is None else p + (pages or 0)
                if t:
                    sha.update((("\n\n" if some else "") + t).encode())
                    some = True
        if n:
            yield done()

    return rows.repartition("b").sortWithinPartitions("b", "o", "t").mapInArrow(run, "bundle string, sha string, page_count long").withColumnRenamed("bundle", bundle)


# A quoted company name that is broken over lines, and labels that begin a line.
BROKEN_NAME = r'(?iu)\b(ООО|ОАО|АО|ПАО|ЗАО)\s*\n\s*([«"])([^»"\n]{1,160})'
BROKEN_QUOTE = r'(?iu)(\b(?:ООО|ОАО|АО|ПАО|ЗАО)\s+[«"][^»"\n]{1,160})\n\s*(?=[^»"\n]{1,160}[»"])'
INLINE_LABEL = r"(?iu)\s+((?:Банк|ИНН|ОГРН|КПП|БИК|Адрес|Арендодатель|Арендатор)\s*:)"


def _rejoined(texts: pd.Series) -> pd.Series:
    """Company names that are broken over lines, joined until nothing changes."""
    name, quote = re.compile(BROKEN_NAME), re.compile(BROKEN_QUOTE)

    def one(text: str | None) -> str | None:
        before = None
        while text is not None and text != before:
            before, text = text, quote.sub(r"\1 ", name.sub(r"\1 \2\3", text))
        return text

    return texts.map(one)


def normal_pdf_text(text: Column) -> Column:
    """Text of a PDF with company names rejoined, labels at line starts, and without trailing blanks and many empty lines."""
    out = F.pandas_udf(_rejoined, "string")(F.regexp_replace(text, r"\r\n?", "\n"))
    for pattern, to in ((INLINE_LABEL, "\n$1"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return out


def strike_lines(drawings: DataFrame) -> DataFrame:
    """Horizontal lines (doc_id, page, x0, x1, y, color) of drawings (doc_id, page, kind, x0, y0, x1, y1, color): lines, and flat boxes."""
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    flat = ((F.col("kind") == "line") & (high <= 1) & (wide >= 2)) | ((F.col("kind") == "box") & (high <= 2) & (wide >= 2))
    return drawings.where(flat).select("doc_id", "page", F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "color")


def revision_margin(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, margin) where two or more coloured lines stand in the right third: what begins there is a balloon."""
    rows = lines.join(pages, ["doc_id", "page"]).where(F.col("color").isNotNull() & (F.col("x0") >= 0.65 * F.col("width")) & (F.col("x1") - F.col("x0") >= 20))
    return rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), (F.min("x0") - 2).alias("margin")).where("n > 1").drop("n")


def without_struck(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """chars (doc_id, page, …, x0, y0, x1, y1) that no line crosses in the middle.

    Characters and lines meet in bands of a page. A character's middle part lies in at most two neighbouring bands of its
    size class and has the number of the first; a line is in one band of each class that its page has, and is given to the
    characters that begin there or one above.
    """
    width, height = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.1)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.1))
    class_ = F.greatest(F.ceil(F.log2(height / (2 * BAND))), F.lit(0))
    high = lambda c: BAND * F.pow(F.lit(2.0), c)
    first = F.floor((F.col("y0") + (STRUCK_LOW - 0.01) * height) / high(F.col("_class")))
    a = chars.withColumn("_class", class_).withColumn("_band", first)
    classes = a.groupBy(F.col("doc_id").alias("_d"), F.col("page").alias("_p")).agg(F.collect_set("_class").alias("_classes"))
    b = lines.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y").alias("_y")).join(classes, ["_d", "_p"])
    b = b.select("_d", "_p", "_x0", "_x1", "_y", F.explode("_classes").alias("_k"))
    at = F.floor(F.col("_y") / high(F.col("_k")))
    b = b.select("*", F.explode(F.array(at, at - 1)).alias("_b"))
    middle = (F.col("x0") + F.col("x1")) / 2
    overlap = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    struck = middle.between(F.col("_x0") - 0.5, F.col("_x1") + 0.5) & ((F.col("_y") - F.col("y0")) / height).between(STRUCK_LOW, STRUCK_HIGH) & (overlap / width >= STRUCK_OVERLAP)
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("_class") == F.col("_k")) & (F.col("_band") == F.col("_b")) & struck
    return a.join(b, on, "left_anti").select(*chars.columns)


def page_text(chars: DataFrame, lines: DataFrame, margins: DataFrame) -> DataFrame:
    """(doc_id, page, text, removed) of chars (doc_id, page, line, pos, c, line_x0, x0, y0, x1, y1) without struck ones and balloons."""
    total = chars.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("all"))
    kept = without_struck(chars, lines).join(margins, ["doc_id", "page"], "left").where(F.col("margin").isNull() | (F.col("line_x0") < F.col("margin")))
    text = F.rtrim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), ""), r"[ \t]{2,}", " "))
    rows = kept.groupBy("doc_id", "page", "line").agg(text.alias("t"), F.count(F.lit(1)).alias("n"))
    pages = rows.groupBy("doc_id", "page").agg(F.sum("n").alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.btrim("t") != "", F.struct("line", "t")))), lambda x: x["t"]), "\n").alias("text"))
    return total.join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), (F.col("all") - F.coalesce("kept", F.lit(0))).alias("removed"))


def ocr_pages(pages: DataFrame, ocr: Callable[[bytes], str] | None) -> DataFrame:
    """pages (doc_id, page, text, image) whose text is blank take that of ocr, an empty one where it fails; with ocr_used and warning."""

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        def one(image):
            try:
                return ocr(bytes(image)) if ocr is not None and image is not None else ""
            except Exception:  # whatever an injected reader raises, the page is empty
                return ""

        return images.map(one)

    blank = F.btrim(F.coalesce("text", F.lit(""))) == ""
    rows = pages.withColumn("_r", F.when(blank, read("image")))
    used = F.coalesce("_r", F.lit("")) != ""
    empty = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" has no text"))
    return rows.select("doc_id", "page", F.when(blank, F.coalesce("_r", F.lit(""))).otherwise(F.col("text")).alias("text"), used.alias("ocr_used"), F.when(blank & ~used, empty).alias("warning"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, page_count, ocr_used, warnings) of pages; each page's text is brought to its normal form, without white space at its end."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("page", c)))), lambda x: x[c])
    rows = pages.withColumn("text", F.regexp_replace(normal_pdf_text(F.col("text")), r"(?U)\s+\z", ""))
    return rows.groupBy("doc_id").agg(F.array_join(ordered("text"), "\n").alias("text"), F.count(F.lit(1)).cast("int").alias("page_count"), F.bool_or("ocr_used").alias("ocr_used"), ordered("warning").alias("warnings"))


def compose_pages(layouts: DataFrame, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(doc_id, text, page_count, ocr_used, warnings, removed) of layouts (doc_id, pages: an array of LAYOUT), as one read of a PDF gives them.

    Struck characters and revision balloons are taken out (`removed` of them); a page that has none keeps its own text.
    Blank pages go to ocr. A document without pages has an empty text.
    """
    one = layouts.select("doc_id", F.posexplode("pages").alias("_i", "p")).select("doc_id", (F.col("_i") + 1).alias("page"), "p.*")
    lines = strike_lines(one.select("doc_id", "page", F.inline("drawings")))
    margins = revision_margin(lines, one.select("doc_id", "page", "width"))
    crossed = one.join(lines.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    cut = page_text(crossed.select("doc_id", "page", F.inline("chars")), lines, margins).where("removed > 0")
    pages = one.select("doc_id", "page", "text", "image").join(cut.withColumnRenamed("text", "_cut"), ["doc_id", "page"], "left")
    read = ocr_pages(pages.withColumn("text", F.coalesce("_cut", "text")), ocr)
    removed = cut.groupBy("doc_id").agg(F.sum("removed").alias("removed"))
    found = layouts.where("pages is not null").select("doc_id").join(join_pages(read), "doc_id", "left").join(removed, "doc_id", "left")
    none = F.array().cast("array<string>")
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), F.coalesce("warnings", none).alias("warnings"), F.coalesce("removed", F.lit(0)).alias("removed"))


def _docx(paragraphs_: list[str]) -> bytes:
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' if p != "\f" else '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' for p in paragraphs_)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (
            ("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
            ("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'),
        ):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def to_docx(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `docx`; a form feed in the text is a page break."""

    @F.pandas_udf("binary")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _docx(re.sub("\f", "\n\f\n", t or "").split("\n")))

    return docs.withColumn("docx", make("text"))


def _guarded(old: str) -> re.Pattern:
    """old itself; where it begins and ends with a digit, only outside of larger numbers."""
    head, tail = (r"(?<!\d)" if old[0].isdigit() else ""), (r"(?!\s*\d)" if old[-1].isdigit() else "")
    return re.compile(head + re.escape(old) + tail)


def _replace_in_paragraph(p: ElementTree.Element, old: str, new: str, mode: str) -> int:
    """Replaces old across the runs of a paragraph: what replaces it takes the format of the run where old begins."""
    done, at = 0, 0
    while True:
        runs = [r for r in p.iter(f"{W}r") if r.find(f"{W}t") is not None]
        pieces = [[t.text or "" for t in r.findall(f"{W}t")] for r in runs]
        texts = ["".join(x) for x in pieces]
        hit = _guarded(old).search("".join(texts), at)
        if hit is None:
            return done
        place = 0
        for i, (run, text) in enumerate(zip(runs, texts, strict=True)):
            lo, hi = max(hit.start() - place, 0), min(hit.end() - place, len(text))
            first = place <= hit.start() < place + len(text)
            if lo < hi:
                before, after = text[:lo], text[hi:]
                if first and mode == "highlighted":
                    _set_text(run, before)
                    index = _parent(p, run)
                    marked, tail = _like(run, new, True), _like(run, after, False)
                    index[0].insert(index[1] + 1, marked)
                    index[0].insert(index[1] + 2, tail)
                else:
                    _set_text(run, before + (new if first else "") + after)
            place += len(texts[i])
        done, at = done + 1, hit.start() + len(new)
        if mode == "first":
            return done


def _parent(p: ElementTree.Element, run: ElementTree.Element) -> tuple[ElementTree.Element, int]:
    return next((parent, k) for parent in p.iter() for k, child in enumerate(parent) if child is run)


def _set_text(run: ElementTree.Element, text: str) -> None:
    first, *rest = run.findall(f"{W}t")
    first.text = text
    first.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    for t in rest:
        run.remove(t)


def _like(run: ElementTree.Element, text: str, marked: bool) -> ElementTree.Element:
    """A run of the same format with another text."""
    out = ElementTree.Element(f"{W}r")
    form = run.find(f"{W}rPr")
    form = ElementTree.fromstring(ElementTree.tostring(form)) if form is not None else ElementTree.Element(f"{W}rPr")
    if marked:
        ElementTree.SubElement(form, f"{W}highlight").set(f"{W}val", "yellow")
    out.append(form)
    ElementTree.SubElement(out, f"{W}t")
    _set_text(out, text)
    return out


REWRITTEN = "content binary, applied int, skipped int"


def rewrite_docx(files: DataFrame, values: DataFrame, mode: str = "all") -> DataFrame:
    """files (doc_id, docx) with each old value of values (doc_id, old, new) replaced in the file itself, and applied and skipped.

    Runs keep their formats. Longest values come first. mode: `all` occurrences, the `first` in each paragraph, or all
    as `highlighted` runs. Null files and those that are refused stay as they are.
    """
    if mode not in ("all", "first", "highlighted"):
        raise ValueError(f"unknown mode: {mode}")
    lists = values.where("old <> '' and new <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct((-F.char_length("old")).alias("n"), "old", "new"))).alias("_v"))

    def one(content: bytes | None, pairs) -> tuple[bytes | None, int, int]:
        pairs = [] if pairs is None else list(pairs)
        if content is None or archive_error(content) is not None:
            return content, 0, len(pairs)
        out, applied = io.BytesIO(), set()
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in old.infolist():
                data = old.read(info)
                if info.filename == "word/document.xml":
                    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), events=("start-ns",)):
                        ElementTree.register_namespace(prefix, uri)
                    root = ElementTree.fromstring(data)
                    for k, v in enumerate(pairs):
                        hits = sum(_replace_in_paragraph(p, v["old"], v["new"], mode) for p in root.iter(f"{W}p"))
                        if hits:
                            applied.add(k)
                    data = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
                new.writestr(info, data)
        return out.getvalue(), len(applied), len(pairs) - len(applied)

    @F.pandas_udf(REWRITTEN)
    def run(contents: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(None if c is None else bytes(c), v) for c, v in zip(contents, pairs, strict=True)], columns=["content", "applied", "skipped"])

    rows = files.join(lists, "doc_id", "left").withColumn("_w", run("docx", "_v"))
    return rows.select(*[F.col("_w.content").alias(c) if c == "docx" else c for c in files.columns], F.col("_w.applied").alias("applied"), F.col("_w.skipped").alias("skipped"))


def append_docx(files: DataFrame, bundle: str, order: str) -> DataFrame:
    """(bundle, docx): the bodies of each bundle's files (bundle, order, docx) in one file, a page break between them; its parts are the first file's."""

    def joined(contents: list[bytes]) -> bytes:
        first, *others = (ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml")) for c in contents)
        body = first.find(f"{W}body")
        last = body.find(f"{W}sectPr")
        end = list(body).index(last) if last is not None else len(body)
        for other in others:
            breaks = ElementTree.Element(f"{W}p")
            ElementTree.SubElement(ElementTree.SubElement(breaks, f"{W}r"), f"{W}br").set(f"{W}type", "page")
            for part in [breaks, *(x for x in other.find(f"{W}body") if x.tag != f"{W}sectPr")]:
                body.insert(end, part)
                end += 1
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(contents[0])) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in old.infolist():
                new.writestr(info, ElementTree.tostring(first, encoding="UTF-8", xml_declaration=True) if info.filename == "word/document.xml" else old.read(info))
        return out.getvalue()

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: joined([bytes(c) for c in x]))

    rows = files.where("docx is not null").groupBy(bundle).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "docx"))), lambda x: x["docx"]).alias("_d"))
    return rows.select(bundle, run("_d").alias("docx"))


def write_side_files(sessions: DataFrame, path: str) -> None:
    """Each session's files under path/session_id: metadata and entities as JSON, its DOCX columns as files.

    sessions: session_id, entities_json, binary columns, and others that go into the metadata. Written from the tasks with
    Arrow's file systems, so path may be remote; on a cluster it must be, as a path without a scheme would be each worker's own disk.
    """
    if "://" not in path and not sessions.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, give the folder of side files with its scheme")
    blobs = [c for c, t in sessions.dtypes if t == "binary"]
    meta = F.to_json(F.struct(*[c for c in sessions.columns if c not in (*blobs, "entities_json")])).alias("_meta")
    names = {"_meta": "metadata.json", "entities_json": "entities.json", **{b: f"{b}.docx" for b in blobs}}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for part in parts:
            for row in part.to_pylist():
                folder = f"{root.rstrip('/')}/{row['_id']}"
                system.create_dir(folder, recursive=True)
                for column, name in names.items():
                    if row[column] is not None:
                        with system.open_output_stream(f"{folder}/{name}") as f:
                            f.write(row[column] if isinstance(row[column], bytes) else row[column].encode())
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["n"])

    sessions.select(safe_segment(F.col("session_id")).alias("_id"), meta, "entities_json", *blobs).mapInArrow(run, "n long").agg(F.sum("n")).collect()


SCRUBBED = ("docProps/thumbnail.jpeg", "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml")


def scrub(docs: DataFrame, column: str = "docx") -> DataFrame:
    """docs with a DOCX column freed of properties, authors, dates and times of entries, and `removed`: what was taken out how often."""
    marks = re.compile(rb' w:(author|date|initials|rsid\w*)="[^"]*"')

    def one(content: bytes) -> tuple[bytes, dict[str, int]]:
        counts: dict[str, int] = {}
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in old.infolist():
                data = old.read(info)
                if info.filename in SCRUBBED:
                    counts["parts"] = counts.get("parts", 0) + 1
                    if info.filename.endswith(".jpeg"):
                        continue
                    data = re.sub(rb">[^<>]+<", b"><", data)
                elif info.filename.startswith("word/") and info.filename.endswith(".xml"):
                    data, n = marks.subn(b"", data)
                    counts["attributes"] = counts.get("attributes", 0) + n
                new.writestr(zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue(), counts

    @F.pandas_udf("content binary, removed map<string,int>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(bytes(c)) if c is not None else (None, None) for c in contents], columns=["content", "removed"])

    return docs.withColumn("_s", run(column)).withColumns({column: F.col("_s.content"), "removed": F.col("_s.removed")}).drop("_s")


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """chunks (chunk_id, text) with `vector` from an injected model, asked a batch at a time; null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = model(b["text"].tolist())
            except Exception:  # whatever an injected model raises, its batch has no vectors
                got = [None] * len(b)
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "text": b["text"], "vector": got})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, text string, vector array<float>")


def download_name(name: Column, extension: str) -> Column:
    """A file name's stem, safe for a header, with another extension."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*\z", "")
    return F.concat(F.when(stem != "", F.regexp_replace(stem, r'[\\/:*?"<>|\r\n]', "_")).otherwise(F.lit("document")), F.lit(f".{extension}"))


def bundle_name(names: Column) -> Column:
    """The first name, and how many more there are."""
    return F.when(F.size(names) > 1, F.concat(F.get(names, F.lit(0)), F.lit(" +"), (F.size(names) - 1).cast("string"))).otherwise(F.get(names, F.lit(0)))
