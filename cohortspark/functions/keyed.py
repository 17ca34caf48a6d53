"""Repeatable pseudo-random draws keyed by row content.

``keyed_uniform`` is a pure function of (salt, keys): the same row gets the
same draw on every run, on any partitioning, after any task retry. It is
the only randomness the library uses (never ``rand()``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def keyed_uniform(*keys: Column, salt: str) -> Column:
    """Uniform in [0, 1): first 32 bits of md5('salt|k1|k2...') / 2^32."""
    parts = [F.lit(salt)] + [k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)
