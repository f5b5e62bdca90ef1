"""Columns for people to read: money, dates, places, names and titles (pt-BR)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prumo.fixed_values import NAME_PARTICLES, SOURCE_ZONE
from prumo.functions.text import as_col, collapse, strip


def _money(c: Column) -> Column:
    return F.concat(
        F.when(c < 0, F.lit("-")).otherwise(F.lit("")),
        F.lit("R$ "),
        F.translate(F.format_number(F.abs(c), 2), ",.", ".,"),
    )


def format_brl(c: Column | str) -> Column:
    """Money as a model reads it: nothing or zero is 'não informado'."""
    c = as_col(c).cast("decimal(18,2)")
    return F.when(c.isNull() | (c == 0), F.lit("não informado")).otherwise(_money(c))


def display_brl(c: Column | str) -> Column:
    """Money as a page shows it: only a missing value is a dash."""
    c = as_col(c).cast("decimal(18,2)")
    return F.when(c.isNull(), F.lit("—")).otherwise(_money(c))


def format_when(c: Column | str, zone: str = SOURCE_ZONE) -> Column:
    c = as_col(c)
    return F.when(c.isNull(), F.lit("—")).otherwise(
        F.date_format(F.from_utc_timestamp(c, zone), "dd/MM 'às' HH:mm")
    )


def format_place(city: Column | str, state: Column | str) -> Column:
    return F.concat_ws("/", F.nullif(as_col(city), F.lit("")), F.nullif(as_col(state), F.lit("")))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def sentence_case(c: Column | str) -> Column:
    return _capital(collapse(c))


def proper_name(c: Column | str) -> Column:
    words = F.split(F.lower(as_col(c)), r"\s+")
    return F.array_join(
        F.transform(
            words, lambda w, i: F.when((i > 0) & w.isin(*NAME_PARTICLES), w).otherwise(_capital(w))
        ),
        " ",
    )


def document_title(c: Column | str) -> Column:
    """'Edital: 8---EDITAL-DE-PREGAO.pdf' → 'Edital: Edital de Pregao'."""
    parts = F.split(as_col(c), ": ")
    kind = F.get(parts, F.lit(0))
    title = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ": ")
    title = F.regexp_replace(title, r"(?i)\.(pdf|docx?|zip)$", "")
    title = strip(F.regexp_replace(F.regexp_replace(title, "[-_]+", " "), r"\s+", " "))
    clean = F.when(title.rlike("^[A-Z0-9 ]+$"), proper_name(title)).otherwise(title)
    return F.when(title == "", kind).otherwise(
        F.concat(kind, F.lit(": "), F.regexp_replace(clean, r"^\d+\s+", ""))
    )


def document_label(kind: Column | str, title: Column | str) -> Column:
    return F.concat_ws(": ", as_col(kind), as_col(title))
