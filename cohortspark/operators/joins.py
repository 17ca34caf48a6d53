"""Skew-safe many-to-one joins on a person key.

The outcome join pairs every measurement row with its person's single
cohort row. One person may own a large share of all rows, possibly as
exact copies; AQE's skew-join splitting is driven by shuffle bytes, and
identical rows compress to almost nothing, so it can miss them. This join
splits hot keys by row *count* instead:

* per-key row counts (an aggregate the caller usually has already, e.g.
  the first-measurement pass) give the keys with more than
  ``rows_per_salt`` rows and, for each, ``ceil(rows / rows_per_salt)``
  salts. Of these the ``MAX_HOT_KEYS`` largest are salted and broadcast, a
  fixed bound: any other key has fewer than 1 / MAX_HOT_KEYS of all rows, which
  is no hot key, and is joined unsalted;
* rows of a hot key get a salt from a hash of a per-row id (assigned at the
  scan, so exact copies spread too, and stable under task retries); the
  key's one row on the small side is replicated once per salt;
* all other keys use salt 0, and the join runs on (key, salt): the big side
  is shuffled once, no task receives more than about ``rows_per_salt`` rows
  of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT_CONF = "cohortspark.skew.rowsPerSalt"
ROWS_PER_SALT = 2_000_000
MAX_HOT_KEYS = 10_000
ROW_ID = "measurement_row"


def rows_per_salt(spark) -> int:
    return int(spark.conf.get(ROWS_PER_SALT_CONF, str(ROWS_PER_SALT)))


def salt_plan(counts: DataFrame, key: str, per_salt: int, count_col: str = "n_rows") -> DataFrame:
    """Hot keys and their salt counts: the ``MAX_HOT_KEYS`` largest keys, each
    with that many salts, at most."""
    hot = counts.where(F.col(count_col) > per_salt).orderBy(F.col(count_col).desc(), key).limit(MAX_HOT_KEYS)
    salts = F.least(F.ceil(F.col(count_col) / F.lit(per_salt)), F.lit(MAX_HOT_KEYS))
    return hot.select(key, salts.cast("int").alias("_salts"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    counts: DataFrame,
    per_salt: int | None = None,
    how: str = "inner",
    count_col: str = "n_rows",
) -> DataFrame:
    """``big`` joined to ``small`` (at most one row per key) on ``key``.

    ``counts`` has one row per key with its row count in ``big`` (an upper
    bound is fine). ``big``'s per-row id column ``measurement_row`` spreads a
    hot key's rows; without it the row content is hashed (exact copies then
    stay together). Every source of the library gives the id.
    """
    per_salt = per_salt or rows_per_salt(big.sparkSession)
    hot = F.broadcast(salt_plan(counts, key, per_salt, count_col))
    ident = (
        F.xxhash64(F.col(ROW_ID)) if ROW_ID in big.columns else F.xxhash64(*[F.col(c) for c in big.columns])
    )
    salted_big = (
        big.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(ident, F.col("_salts"))))
        .withColumn("_salt", F.col("_salt").cast("int"))
        .drop("_salts")
    )
    salted_small = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_big.join(salted_small, [key, "_salt"], how).drop("_salt")
