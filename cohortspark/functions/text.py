"""Display-string helpers used by the report frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_or_fallback(name: Column, concept_id: Column, prefix: str = "Condition ") -> Column:
    """The name, or '<prefix><id>' when the name is NULL or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit(prefix), concept_id.cast("string")))


def grouped_int(c: Column) -> Column:
    """Integer with thousands separators: 1234567 -> '1,234,567'."""
    return F.format_number(c.cast("bigint"), 0)


def plain_number(c: Column, dp: int = 2) -> Column:
    """Shortest display of a value at ``dp`` decimals: 26.00 -> '26', 25.50 -> '25.5'."""
    s = c.cast(f"decimal(38,{dp})").cast("string")
    if dp <= 0:
        return s
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def with_unit(value_text: Column, unit: Column) -> Column:
    return F.concat_ws(" ", value_text, unit)
