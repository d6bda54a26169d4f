"""Text functions that several operators share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as \s with (?U) has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EDGE = " \t\r\n:;,.!?-–—()[]{}"
TOKEN = r"[a-zа-я0-9][a-zа-я0-9&.'-]*"


def strip(c: Column, chars: str | None = None) -> Column:
    """White space, or the given characters, off both ends."""
    return F.btrim(c, F.lit(SPACE if chars is None else chars))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fold(c: Column) -> Column:
    """Lower case, with е for ё."""
    return F.translate(F.lower(c), "ё", "е")


def normal_value(c: Column) -> Column:
    """A span's text for policy lookups: trimmed, folded, without punctuation and quotes at its ends."""
    return collapse(strip(fold(strip(c)), EDGE + '"«»'))


def normal_organization(c: Column) -> Column:
    """The same for organizations: quotes stay and are made equal."""
    return collapse(F.translate(strip(fold(strip(c)), EDGE), "«»“”", '""""'))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def around(text: Column, start: Column, end: Column, n: int) -> Column:
    """text from n characters before start to n behind end (offsets from 0, end exclusive)."""
    lo = F.greatest(start - n, F.lit(0))
    return F.substring(text, lo + 1, end + n - lo)


def before(text: Column, start: Column, n: int) -> Column:
    lo = F.greatest(start - n, F.lit(0))
    return F.substring(text, lo + 1, start - lo)


def _head(text: Column, start: Column) -> Column:
    return F.substring(text, F.lit(1), start)


def line(text: Column, start: Column, end: Column) -> Column:
    """The whole line (or lines) around a span."""
    rest = F.substring(text, end + 1, F.char_length(text))
    return F.concat(F.substring_index(_head(text, start), "\n", -1), F.substring(text, start + 1, end - start), F.substring_index(rest, "\n", 1))


def line_start(text: Column, start: Column) -> Column:
    return start - F.char_length(F.substring_index(_head(text, start), "\n", -1))


def lines_with_previous(text: Column, start: Column, end: Column) -> Column:
    """The span's line with the one before it."""
    first = line_start(text, start)
    previous = F.substring_index(F.substring(text, F.lit(1), F.greatest(first - 1, F.lit(0))), "\n", -1)
    return F.when(first > 0, F.concat(previous, F.lit("\n"), line(text, start, end))).otherwise(line(text, start, end))


def after_line(text: Column, end: Column, n: int) -> Column:
    """n characters from the end of the span's line on."""
    rest = F.substring(text, end + 1, F.char_length(text))
    return F.substring(rest, F.char_length(F.substring_index(rest, "\n", 1)) + 1, F.lit(n))


def trimmed_start(text: Column, start: Column, end: Column) -> Column:
    """A span's start without leading white space."""
    value = F.substring(text, start + 1, end - start)
    return start + F.char_length(F.regexp_extract(value, r"(?U)\A(\s*)", 1))


def trimmed_end(text: Column, start: Column, end: Column) -> Column:
    """A span's end without trailing blanks, line ends, commas, semicolons and colons."""
    value = F.substring(text, start + 1, end - start)
    return end - F.char_length(F.regexp_extract(value, r"([ \t\r\n,;:]*)\z", 1))


def quote_pattern(c: Column) -> Column:
    """A regular expression that matches the value itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def safe_segment(c: Column) -> Column:
    """A name fit for a path."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 128)


def n_tokens(c: Column) -> Column:
    """Length in tokens when no tokenizer is given: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("int")


def html(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parse_time(c: Column) -> Column:
    """ISO time; without a zone it is UTC (the session's zone); malformed: null."""
    return F.try_to_timestamp(c)


def expired(created: Column, now: Column, hours: int) -> Column:
    return F.coalesce(now - created > F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once: a generator keeps the optimizer from writing them out wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
