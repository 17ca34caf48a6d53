"""Keyed sampling, clamping and row ids.

Every draw is ``keyed_uniform`` of the row's own key, so results repeat
exactly across runs, partitionings and task retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed_uniform
from ..functions.numeric import clamp
from ..session import Scratch, query_scratch
from ..sources import model

SALT_CONTROL_SAMPLE = "control_sample"


def person_uniform(frame: DataFrame, salt: str = "person") -> DataFrame:
    """Each person's keyed uniform draw."""
    return frame.select("person_id", keyed_uniform(F.col("person_id"), salt=salt).alias("u"))


def sample_controls(
    controls: DataFrame, rate: float = model.CONTROL_SAMPLE_RATE, salt: str = SALT_CONTROL_SAMPLE
) -> DataFrame:
    """Bernoulli sample of persons at ``rate``, repeatable (a narrow filter)."""
    u = keyed_uniform(F.col("person_id"), salt=salt)
    return controls.select("person_id", "index_date", u.alias("u")).where(F.col("u") < F.lit(rate))


def clamp_by_category(values: DataFrame, bounds: DataFrame, value_col: str = "value_numeric") -> DataFrame:
    """Winsorise each value to its (cohort, analyte) bounds; bounds are data.

    The bounds table is a fixed literal (one row per cohort x analyte), so it
    is broadcast; values without bounds pass through unchanged.
    """
    return values.join(F.broadcast(bounds), ["cohort", "measurement_concept_id"], "left").withColumn(
        "value_clamped", clamp(F.col(value_col), F.col("clamp_low"), F.col("clamp_high"))
    )


def row_ids(
    df: DataFrame,
    order_cols: Sequence[str],
    id_col: str = "row_id",
    num_slices: int | None = None,
    chunk_rows: int = 1_000_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Dense 1..N ids following ``order_cols`` (then all other columns).

    A global ROW_NUMBER() is a one-task window; this is the distributed
    form:

    1. exact copies collapse to one row with a multiplicity (map-side), cut
       into chunks of ``chunk_rows`` copies, so that a heavily repeated row is
       several rows that can lie in different slices;
    2. the chunks are range-partitioned into consecutive slices, frozen by
       writing them once to the shared folder (``scratch`` owns the copy;
       default: the session's query scratch);
    3. slice totals (one row per slice) give each slice's first id, and one
       running count inside each slice gives each chunk its block of ids;
    4. chunks are expanded to their copies where they are.

    Identical rows are interchangeable, so ids are deterministic as a
    multiset of rows.
    """
    spark = df.sparkSession
    slices_n = num_slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(df.columns)
    order = list(order_cols) + [c for c in cols if c not in order_cols]
    sort_exprs = [F.col(c).asc_nulls_last() for c in order] + [F.col("_chunk").asc()]

    distinct = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_all"))
    last = F.floor((F.col("_all") - 1) / F.lit(chunk_rows)).cast("long")
    chunks = distinct.select(*cols, "_all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_chunk")).select(
        *cols, "_chunk", F.least(F.lit(chunk_rows), F.col("_all") - F.col("_chunk") * chunk_rows).alias("_copies")
    )
    ranged = (scratch or query_scratch(spark)).materialize(
        chunks.repartitionByRange(slices_n, *sort_exprs).withColumn("_slice", F.spark_partition_id()), "row_id_slices"
    )

    sizes = ranged.groupBy("_slice").agg(F.sum("_copies").alias("_slice_n"))
    # One row per slice: the ordering window runs over at most num_slices rows.
    starts = sizes.select(
        "_slice",
        (
            F.sum("_slice_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_slice_n")
        ).alias("_slice_start"),
    )
    in_slice = Window.partitionBy("_slice").orderBy(*sort_exprs).rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        ranged.withColumn("_cum", F.sum("_copies").over(in_slice))
        .join(F.broadcast(starts), "_slice")
        .select(*cols, (F.col("_slice_start") + F.col("_cum") - F.col("_copies")).alias("_before"), "_copies")
    )
    each = blocks.select(*cols, "_before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i"))
    return each.select(*cols, (F.col("_before") + F.col("_i")).cast("long").alias(id_col))
