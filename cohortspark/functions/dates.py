"""Date helpers for yyyymmdd integer dates and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_yyyymmdd(c: Column, strict: bool = True) -> Column:
    """DATE from a yyyymmdd integer (or digit string).

    Strict parsing uses integer arithmetic + ``make_date`` (no string round
    trip per row, stays in codegen) and fails on an impossible month/day,
    like the original study's strptime. ``strict=False`` returns NULL instead, for
    dirty extracts.
    """
    if not strict:
        return F.try_to_date(c.cast("string"), "yyyyMMdd")
    n = c.cast("int")
    return F.make_date(F.floor(n / 10000).cast("int"), (F.floor(n / 100) % 100).cast("int"), (n % 100).cast("int"))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later`` (DATE_DIFF('day', earlier, later))."""
    return F.datediff(later, earlier).cast("int")
