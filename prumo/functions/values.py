"""Timestamps and exact numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prumo.fixed_values import SOURCE_ZONE
from prumo.functions.text import as_col

HAS_OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def localize(c: Column | str, zone: str = SOURCE_ZONE) -> Column:
    """ISO text to an instant; text without an offset is wall-clock time in `zone`."""
    text = F.nullif(as_col(c), F.lit(""))
    stamp = F.try_to_timestamp(text)
    return F.when(text.rlike(HAS_OFFSET), stamp).otherwise(F.to_utc_timestamp(stamp, zone))


def exact_decimal(c: Column | str, scale: int = 2) -> Column:
    """A JSON number as the decimal it was written as, not as its nearest double."""
    return as_col(c).cast("string").cast(f"decimal(18,{scale})")


def micros(c: Column | str) -> Column:
    return F.unix_micros(as_col(c).cast("timestamp"))
