"""Running sums within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], lead: Sequence[str] = ()) -> DataFrame:
    """``rows`` plus, for every column c of ``sums``, ``before_<c>`` (its sum over the
    earlier rows of the group) and ``total_<c>`` (over the whole group), and
    ``lead``: a struct of the named columns of the group's first row.

    Ascending, nulls first; null groups are groups. Rows are range-partitioned by
    group and order into slices and written once, so a lost executor cannot
    change the slices; sums run within (slice, group), and a group that goes over
    several slices takes what its earlier slices hold from a table of at most two
    rows a slice (a slice holds at most two groups that go beyond it), which is
    broadcast. A group of any size is so spread over the slices. ``order`` should
    end in a unique column, which also spreads repeated rows.
    """
    spark = rows.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group, order, lead = list(group), list(order), list(lead)
    ranged = rows.repartitionByRange(slices, *[F.col(c).asc_nulls_first() for c in group + order])
    frozen = materialize(ranged.withColumn("slice", F.spark_partition_id()), "running")

    first = F.min(F.struct(*order, F.struct(*(lead or order[:1])).alias("lead")))
    parts = frozen.groupBy("slice", *group).agg(first.alias("first"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    beyond = parts.select(
        F.col("slice").alias("_slice"),
        *[F.col(c).alias(f"_{c}") for c in group],
        F.count("*").over(whole).alias("_slices"),
        F.min("first").over(whole)["lead"].alias("_lead"),
        *[F.coalesce(F.sum(f"sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"sum_{c}").over(whole).alias(f"_total_{c}") for c in sums],
    ).where("_slices > 1")
    here = Window.partitionBy("slice", *group)
    past = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = frozen.select(
        "*",
        F.min(F.struct(*order, F.struct(*(lead or order[:1])).alias("lead"))).over(here)["lead"].alias("_own_lead"),
        *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_past_{c}") for c in sums],
        *[F.sum(c).over(here).alias(f"_here_{c}") for c in sums],
    )
    same: Column = F.col("slice") == F.col("_slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(F.broadcast(beyond), same, "left").select(
        *rows.columns,
        *[(F.col(f"_past_{c}") + F.coalesce(f"_before_{c}", F.lit(0))).alias(f"before_{c}") for c in sums],
        *[F.coalesce(f"_total_{c}", f"_here_{c}").alias(f"total_{c}") for c in sums],
        *([F.coalesce("_lead", "_own_lead").alias("lead")] if lead else []),
    )
