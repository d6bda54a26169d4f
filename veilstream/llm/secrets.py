"""Secret scan: base patterns, and strings in sensitive contexts that a primed compressor cannot foresee.

A candidate is a whole run of 16 or more characters from the alphabet of keys and tokens, without what a base span
takes of it. Candidates on neighbouring lines, with a dot between them, or between the same BEGIN and END marks form a
chain. A chain counts if one of its members stands within NEAR characters of a sensitive word. A member's novelty is the
number of bytes it adds when it is compressed after the text around its chain by zstandard primed with a dictionary,
divided by its length. The dictionary holds the WORDS words and parts of identifiers that are in most documents of the
corpus (letters only, so no key enters it whole), behind those that code around secrets usually says; a run of more than WHOLE characters is as novel as its most
novel window. Members of at least NOVEL are reported as spans of kind `novel` if one of these in the chain has letters and
digits (ordinary long words are as novel as keys of letters alone). What stands between two such members of a chain is
reported with them, and so are the chain's short parts: all lines between BEGIN and END, a part between two reported
dotted ones, and the last line after two or more. Base
spans always stay.

Edge cases: null or empty text has no spans; spans count code points; what a base span takes is not
reported again; repeated rows get equal results; null doc_ids are scanned too; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm import hashing as H

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length of which short ones are dropped
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"pass(word|wd|phrase)?|secret|token|api_?key|credential|auth|private|bearer|access|key\b|pwd|ssh-|-----BEGIN", re.IGNORECASE | re.ASCII)
NEAR, AROUND = 48, 256
#: Longer runs are measured in windows, as a long text foretells its own signs; above LONG, words inside a run count too.
LEAST, WHOLE, WINDOW, LONG = 16, 48, 32, 512
#: A run alone on its line (a backslash stands for an escaped line break), and what may stand beside it there.
LINE = re.compile(r"(?:^|\\)[ \t\"'>|#*]*([A-Za-z0-9+/_=-]+)[ \t\"',;]*\r?(?=$|\\)", re.MULTILINE)
DOTTED = re.compile(r"\.([A-Za-z0-9+/_=-]{0,15})\.")
BESIDE = " \t\r\n\"',;>|#*\\"
SHORT = re.compile(r"[A-Za-z0-9+/_=-]{1,15}(?=[ \t\"',;]*(?:[\r\n\\]|\Z))")
#: Added bytes per character, once identifiers are divided into words. Random strings add about 1, names of known words
#: about 0.6 or less.
NOVEL = 0.7

#: Words of the corpus in the dictionary.
WORDS = 4096
#: What code and prose around secrets usually says: the end of the dictionary that the compressor starts with.
IDENTIFIERS = " ".join(
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret credential authorization bearer "
    "username user login session cookie config settings environment export import return function class static const public private protected void "
    "string integer boolean null true false default value name host port database connection localhost http https www com org net index html json xml "
    "yaml request response header content type application text plain utf encoding base64 sha256 md5 hash digest signature certificate begin end key "
    "the and that with from this have which their will would there been were they about after before because between through under over into".split()
)


def corpus_words(docs: DataFrame, most: int = WORDS) -> str:
    """The `most` words that are in most documents, rarest first. Words are runs of letters, divided at inner capitals.

    All documents are counted; `most` words reach the driver.
    """
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit("([A-Za-z][a-z]{2,23})"), 1)
    rows = docs.select(F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = rows.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join(r["word"] for r in reversed(top))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Where an identifier's words begin: at capitals after small letters, and at signs.
_WORD = re.compile(r"(?<=[a-z])(?=[A-Z])|[_/+=-]+")


def _divided(text: str) -> str:
    return _WORD.sub(" ", text).lower()


class Novelty:
    def __init__(self, corpus: str = "") -> None:
        words = zstandard.ZstdCompressionDict(f"{corpus} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=3)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes per byte of text[start:end] behind the text around it."""
        return self.added(self.around(text, start, end), text[start:end])

    def around(self, text: str, start: int, end: int) -> tuple[bytes, int]:
        around = (_divided(text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]) + " ").encode()
        return around, len(self.press.compress(around))

    def added(self, around: tuple[bytes, int], part: str) -> float:
        divided = _divided(part).encode()
        return (len(self.press.compress(around[0] + divided)) - around[1]) / len(divided)

    def reaches(self, threshold: float, around: tuple[bytes, int], part: str) -> bool:
        """Whether part, or of a long part some window, is that novel."""
        if self.added(around, part) >= threshold:
            return True
        return len(part) > WHOLE and any(self.added(around, part[min(k, len(part) - WINDOW) :][:WINDOW]) >= threshold for k in range(0, len(part), WINDOW))


def _blocks(text: str) -> list[tuple[int, int]]:
    """What stands between BEGIN and END marks."""
    out, at = [], 0
    while (begin := text.find("-----BEGIN", at)) >= 0 and (end := text.find("-----END", begin)) >= 0:
        begin = text.rfind("-----BEGIN", begin, end) + len("-----BEGIN")
        label = text.find("-----", begin, end)
        out.append((label + 5 if label >= 0 else begin, end))
        at = end + len("-----END")
    return out


def _items(text: str, taken: list[tuple[int, int, int]], blocks: list[tuple[int, int]]) -> list[tuple[int, int, int | None]]:
    """(start, end, kind) of candidates, of short lines in blocks and of base spans, in order; kind is None for the first two."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if blocks:
        runs = sorted({*runs, *(m.span(1) for lo, hi in blocks for m in LINE.finditer(text, lo, hi) if m.end(1) - m.start(1) < LEAST)})
    out, i, at = [], 0, 0
    joined: list[list[int]] = []  # base spans, overlapping ones as one
    for s, k, e in taken:
        if joined and s < joined[-1][1]:
            joined[-1][1], joined[-1][2] = max(e, joined[-1][1]), min(k, joined[-1][2])
        else:
            joined.append([s, e, k])
    for start, end in runs:
        while i < len(joined) and joined[i][1] <= start:
            i += 1
        at, j, least = start, i, LEAST if end - start >= LEAST else 1
        while j < len(joined) and joined[j][0] < end:
            if joined[j][0] - at >= least:
                out.append((at, joined[j][0], None))
            at, j = max(at, joined[j][1]), j + 1
        if end - at >= least:
            out.append((at, end, None))
    return sorted(out + [(s, e, k) for s, e, k in joined], key=lambda x: x[:2])


def _joins(gap: str) -> bool:
    """A dot, a short part between dots, or one line break with nothing but signs beside it."""
    if DOTTED.fullmatch(gap):
        return True
    gap = gap.replace("\\r", "\\")
    return gap in ("", ".") or (not gap.strip(BESIDE) and gap.count("\n") <= 1 and any(c in gap for c in "\n\r\\"))


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, threshold: float = NOVEL) -> list[tuple[int, int]]:
    if not CANDIDATE.search(text) and "-----BEGIN" not in text:
        return []
    blocks = _blocks(text)
    items = _items(text, taken, blocks)
    if all(k is not None for _, _, k in items):
        return []
    marks = [m.span() for m in SENSITIVE.finditer(text)]
    if not marks:
        return []
    first, last = [s for s, _ in marks], [e for _, e in marks]

    def near(start: int, end: int, kind: int | None) -> bool:
        i = bisect_right(last, start - NEAR)
        if i < len(marks) and first[i] < end + NEAR and (kind == 0 or end - start > LONG or not (first[i] >= start and last[i] <= end)):
            return True
        i = max(i, bisect_right(last, end))  # the first word that is not inside
        return i < len(marks) and first[i] < end + NEAR

    begins = [lo for lo, _ in blocks]

    def block(start: int, end: int) -> int:
        i = bisect_right(begins, start) - 1
        return i if i >= 0 and end <= blocks[i][1] else -1

    chains: list[list[tuple[int, int, int | None]]] = []
    for item in items:
        before = chains[-1][-1] if chains else None
        b = block(*item[:2])
        if before and ((b >= 0 and b == block(*before[:2])) or (b == block(*before[:2]) and _joins(text[before[1] : item[0]]))):
            chains[-1].append(item)
        else:
            chains.append([item])
    out = []
    for chain in chains:
        members = [(s, e) for s, e, k in chain if k is None]
        b = block(*chain[0][:2])
        if members and (b >= 0 or any(near(*x) for x in chain)):
            out += _reported(text, chain, members, b >= 0, novelty, threshold)
    return out


def _reported(text: str, chain: list[tuple[int, int, int | None]], members: list[tuple[int, int]], in_block: bool, novelty: Novelty, threshold: float) -> list[tuple[int, int]]:
    """The spans of a chain near a sensitive word."""
    mixed = lambda part: bool(_DIGIT.search(part) and _LETTER.search(part))
    if not in_block and not any(mixed(text[s:e]) for s, e in members):
        return []
    around = novelty.around(text, chain[0][0], chain[-1][1])
    if in_block:
        whole = "".join(text[s:e] for s, e in members)
        if mixed(whole) and len(whole) >= LEAST and novelty.reaches(threshold, around, whole):
            return members
        return []
    novel = [i for i, (s, e) in enumerate(members) if novelty.reaches(threshold, around, text[s:e]) or (len(chain) > 1 and novelty(text, s, e) >= threshold)]
    if not any(mixed(text[slice(*members[i])]) for i in novel):
        return []
    found = members[novel[0] : novel[-1] + 1]
    found += [m.span(1) for (_, e), (s, _) in zip(found, found[1:]) if (m := DOTTED.fullmatch(text, e, s)) and m[1]]
    if len(chain) > 1 and chain[-1][:2] == found[-1]:
        end = at = chain[-1][1]
        while at < len(text) and text[at] in BESIDE:
            at += 1
        if (short := SHORT.match(text, at)) and at > end and _joins(text[end:at]):
            found.append(short.span())
    return sorted(found)


FOUND = "doc_id long, starts array<int>, ends array<int>, kinds array<string>"


def _scan(threshold: float, words: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        long_run = re.compile(rb"[A-Za-z0-9+/_=.:-]{12,}")
        names = (*KINDS, "novel")
        for part in parts:
            for lo, hi, blobs in H.batches(part.column(1)):
                rows = []
                for blob in blobs:
                    if not long_run.search(blob) and b"-----BEGIN" not in blob:  # every other kind of span holds such a run
                        rows.append(((), (), ()))
                        continue
                    text = blob.decode()
                    spans = base_spans(text)
                    spans = sorted(spans + [(s, 3, e) for s, e in novel_spans(text, spans, novelty, threshold)])
                    rows.append(([s for s, _, _ in spans], [e for _, _, e in spans], [names[k] for _, k, _ in spans]))
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0)[lo:hi], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "starts", "ends", "kinds"])

    return run


def scan(docs: DataFrame, threshold: float = NOVEL) -> DataFrame:
    """(doc_id, starts, ends, kinds) for each row of docs (doc_id, text): spans by start, then kind as listed."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(threshold, corpus_words(texts)), FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as kind:start:end, comma-joined, with the digest of the base ones."""
    all_ = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    joined = lambda x: F.array_join(x, ",")
    base = F.filter(all_, lambda s: ~s.startswith("novel:"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(all_).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", threshold: float = NOVEL) -> DataFrame:
    """docs with each secret replaced by `mark`; every row stays, and all of its columns."""
    place = docs.columns.index("text")
    words = corpus_words(docs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for part in parts:
            kind = part.schema.field(place)
            for lo, hi, blobs in H.batches(part.column(place)):
                given = part.slice(lo, hi - lo)
                out = [None if empty else without(blob.decode(), mark, novelty, threshold) for blob, empty in zip(blobs, given.column(place).is_null().to_pylist(), strict=True)]
                yield given.set_column(place, kind, pa.array(out, kind.type))

    return docs.mapInArrow(run, docs.schema)


def without(text: str, mark: str, novelty: Novelty, threshold: float = NOVEL) -> str:
    """text with each secret replaced by `mark`; secrets that overlap are one."""
    spans = base_spans(text)
    spans = sorted([(s, e) for s, _, e in spans] + novel_spans(text, spans, novelty, threshold))
    at, kept = 0, []
    for s, e in spans:
        if s >= at:
            kept += [text[at:s], mark]
        at = max(at, e)
    return "".join((*kept, text[at:])) if spans else text
