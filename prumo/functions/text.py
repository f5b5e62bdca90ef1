"""Text columns: cleaning, normal forms, fragments, numbers, sort keys, digests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import MIN_FRAGMENT

# White space and word characters of Unicode text, marks around a quotation,
# signs that skip text.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
EDGE_MARKS = " .;,:\"'"
ELLIPSES = r"\.{3,}|…|\[\s*\.{0,3}\s*\]"
# Curly quotes and dashes to their plain forms; ordinal marks to letters.
PLAIN_FROM, PLAIN_TO = "“”‘’–—ºª", "\"\"''--oa"

# File signatures.
SIGNATURES = {
    "pdf": b"%PDF",
    "zip": b"PK\x03\x04",
    "doc": b"\xd0\xcf\x11\xe0",
    "rar": b"Rar!",
    "7z": b"7z\xbc\xaf",
}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s)
    )


@F.pandas_udf(T.StringType())
def ascii_folded(texts: pd.Series) -> pd.Series:
    def fold(s):
        if s is None or s.isascii():
            return s
        return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()

    return texts.map(fold)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.btrim(F.regexp_replace(as_col(c), f"{SPACE}+", " "))


def clean_text(c: Column | str) -> Column:
    """Page text without NULs, with single spaces and at most one empty line in a row."""
    c = F.regexp_replace(as_col(c), "\\x00", "")
    c = F.regexp_replace(c, "[ \\t\\u00a0]+", " ")
    c = F.regexp_replace(c, " *\\n *", "\n")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def fold_layout(c: Column) -> Column:
    """Undo what page layout does to a sentence; `c` is already in normal form."""
    c = F.lower(F.translate(c, PLAIN_FROM, PLAIN_TO))
    c = F.regexp_replace(c, f"({WORD})-{SPACE}*\\n{SPACE}*({WORD})", "$1$2")
    return collapse(c)


def normalize_text(c: Column | str) -> Column:
    """The form in which quotations and pages are compared."""
    return fold_layout(nfkc(as_col(c)))


def normalize_question(c: Column | str) -> Column:
    folded = ascii_folded(F.lower(as_col(c)))
    return collapse(F.regexp_replace(folded, f"[^A-Za-z0-9_\\s]", " "))


def fragments_of(normalized: Column | str) -> Column:
    """Pieces of an already normalised quotation between ellipses, long enough to prove something."""
    pieces = F.transform(F.split(as_col(normalized), ELLIPSES), lambda p: F.btrim(p, F.lit(EDGE_MARKS)))
    return F.filter(pieces, lambda p: F.length(p) >= MIN_FRAGMENT)


def fragments(c: Column | str) -> Column:
    return fragments_of(normalize_text(c))


def numbers(c: Column | str) -> Column:
    """The distinct numbers written in a text, as written."""
    return F.array_distinct(F.regexp_extract_all(as_col(c), F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), F.lit(0)))


def numbers_subset(inner: Column | str, outer: Column | str) -> Column:
    return F.size(F.array_except(numbers(inner), numbers(outer))) == 0


def natural_key(c: Column | str) -> Column:
    """Sort key under which 'Anexo 2' comes before 'Anexo 10': text and number parts alternate,
    text first; a number is written with its digit count in front."""
    low = F.lower(as_col(c))
    parts = F.regexp_extract_all(low, F.lit(r"\d+|\D+"), F.lit(0))
    lead = F.when(low.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=\\d)", "")
        return F.when(
            p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), F.lit(":"), digits)
        ).otherwise(p)

    return F.concat(lead, F.transform(parts, part))


def not_main_file(c: Column | str) -> Column:
    """False for the notice itself: 'edital' appears and 'anexo' does not appear before it."""
    low = F.lower(as_col(c))
    at = F.instr(low, "edital")
    return ~((at > 0) & ~F.contains(F.substring_index(low, "edital", 1), F.lit("anexo")))


def reading_order(c: Column | str) -> list[Column]:
    return [not_main_file(c).asc(), natural_key(c).asc(), as_col(c).asc()]


def collapse_cut(c: Column | str, n: int, ellipsis: str = "") -> Column:
    flat = collapse(c)
    cut = F.substring(flat, 1, n)
    return F.when(F.length(flat) > n, F.concat(cut, F.lit(ellipsis))).otherwise(flat) if ellipsis else cut


def suffix_of(name: Column | str) -> Column:
    """Lower-case extension after the last dot; a leading dot does not start one."""
    base = F.element_at(F.split(F.coalesce(as_col(name), F.lit("")), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.*[^/]\.([^./]+)$", 1))


def detect_format(content: Column | str, name: Column | str) -> Column:
    """Format by the first bytes, then by the name. Telling DOCX from ZIP needs the member
    list, which only extraction reads."""
    head = F.substring(as_col(content), 1, 4)
    found = F
    for kind, magic in SIGNATURES.items():
        found = found.when(head == F.lit(magic), kind)
    suffix = suffix_of(name)
    return found.otherwise(F.when(suffix == "", "desconhecido").otherwise(suffix))


def digest(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def disposition_name(header: Column | str) -> Column:
    name = strip(F.regexp_extract(as_col(header), "filename\\*?=(?:UTF-8'')?\"?([^\";]+)", 1))
    return F.nullif(name, F.lit(""))
