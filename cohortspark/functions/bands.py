"""Age banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import model


def age_band(age: Column) -> Column:
    """Half-open age bands; NULL age gives a NULL band."""
    expr = None
    for label, lo, hi in model.AGE_BANDS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (age >= lo)
        if hi is not None:
            cond = cond & (age < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(age.isNotNull(), expr)


def age_band_order(band: Column) -> Column:
    """Display ordinal of a band label (1 = youngest)."""
    expr = None
    for i, (label, _, _) in enumerate(model.AGE_BANDS):
        expr = F.when(band == label, F.lit(i + 1)) if expr is None else expr.when(band == label, F.lit(i + 1))
    return expr
