"""Grouped descriptive statistics, with exact distributed percentiles.

Why not ``F.percentile``: the exact built-in keeps a value -> count map per
group and merges it in the one task that owns the group. Cohort statistics
have very few groups (two cohorts), so that single task would hold every
distinct value of half the data. ``exact_percentiles`` below gives the same
bits while every step is spread across the cluster, at every data size:

1. counts: rows per (group, value), with partial aggregation map-side, so
   repeated values collapse before the shuffle;
2. the counts are range-partitioned on (group, value): a hot group is cut into
   many consecutive slices, and the slice assignment is frozen by writing the
   counts once to the shared folder, so all reads below see the same slices
   (and a lost executor cannot re-slice them);
3. per (slice, group) row counts -> a small table (at most slices + groups
   rows) -> prefix sums give each slice's starting rank inside its group;
4. the target ranks floor/ceil(p * (n - 1)) are located in their slice, and
   only those slices get a local running count, to read off the values.

``group_stats`` counts rows per (group, person, value) instead, so the one
written copy serves every statistic, and the joins above it run once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_dp
from ..session import Scratch, query_scratch

BOX_STATS = [
    "n_measurements",
    "n_patients",
    "mean_value",
    "median_value",
    "p25",
    "p75",
    "min_value",
    "max_value",
    "std_dev",
]
PERCENTILE_STATS = {"median_value": 0.5, "p25": 0.25, "p75": 0.75}

COUNT_STATS = {"n_measurements", "n_patients"}


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal-or-both-NULL keys; the right copies of the keys are dropped."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])


def frozen_slices(
    df: DataFrame, group_cols: Sequence[str], value_col: str, weight_col: str | None, scratch: Scratch, num_slices: int, extra=()
) -> DataFrame:
    """Rows counted per (group, value, *extra): (group cols, _v, extra, _c, _slice),
    in consecutive slices by group and value (NULL values first), written once."""
    G = list(group_cols)
    weight = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    counts = df.select(*G, F.col(value_col).cast("double").alias("_v"), *extra, weight.alias("_w"))
    counts = counts.groupBy(*G, "_v", *extra).agg(F.sum("_w").alias("_c"))
    order = [F.col(c).asc_nulls_first() for c in [*G, "_v", *extra]]
    return scratch.materialize(
        counts.repartitionByRange(num_slices, *order).withColumn("_slice", F.spark_partition_id()), "value_counts"
    )


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    percentiles: Mapping[str, float],
    num_slices: int | None = None,
    weight_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per group, one column per name.

    ``weight_col`` (optional) gives each row a multiplicity, for inputs that
    were pre-aggregated into (value, count) rows. ``scratch`` owns the written
    copy (default: the session's query scratch).

    Returns ``group_cols + list(percentiles)``; groups whose values are all
    NULL are absent (callers left-join). Equal to the built-in ``percentile``
    to the last bit, infinities included.
    """
    G = list(group_cols)
    if not G:
        df = df.withColumn("__all", F.lit(0))
        return exact_percentiles(df, ["__all"], value_col, percentiles, num_slices, weight_col, scratch).drop("__all")
    spark = df.sparkSession
    slices_n = num_slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(value_col).isNotNull())
    ranged = frozen_slices(rows, G, value_col, weight_col, scratch or query_scratch(spark), slices_n)
    return sliced_percentiles(ranged, G, percentiles)


def sliced_percentiles(ranged: DataFrame, G: list[str], percentiles: Mapping[str, float]) -> DataFrame:
    """Percentiles from ``frozen_slices`` rows; NULL values do not count."""
    names = list(percentiles)
    ranged = ranged.where(F.col("_v").isNotNull()).groupBy("_slice", *G, "_v").agg(F.sum("_c").alias("_c"))

    keys = ["_slice"] + G
    by_group = Window.partitionBy(*G)
    slices = ranged.groupBy(*keys).agg(F.sum("_c").alias("_slice_n"))
    slices = slices.select(
        *keys,
        "_slice_n",
        (
            F.sum("_slice_n").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_slice_n")
        ).alias("_slice_start"),
        F.sum("_slice_n").over(by_group).alias("_group_n"),
    )

    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(percentiles[n])).alias("p")) for n in names])
    )
    targets = slices.select(*keys, "_slice_start", "_slice_n", "_group_n", wanted.alias("_t")).select(
        *keys,
        "_slice_start",
        "_slice_n",
        F.col("_t.name").alias("_name"),
        (F.col("_t.p") * (F.col("_group_n") - 1)).alias("_h"),
    )
    ends = F.explode(
        F.array(
            F.struct(F.lit("lo").alias("end"), F.floor("_h").cast("long").alias("rank")),
            F.struct(F.lit("hi").alias("end"), F.ceil("_h").cast("long").alias("rank")),
        )
    )
    targets = (
        targets.select(*keys, "_slice_start", "_slice_n", "_name", "_h", ends.alias("_e"))
        .where(
            (F.col("_e.rank") >= F.col("_slice_start"))
            & (F.col("_e.rank") < F.col("_slice_start") + F.col("_slice_n"))
        )
        .select(
            *keys,
            "_name",
            "_h",
            F.col("_e.end").alias("_end"),
            (F.col("_e.rank") - F.col("_slice_start")).alias("_local"),
        )
    )

    hit = join_null_safe(ranged, targets.select(*keys).distinct(), keys, "left_semi")
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_cum", F.sum("_c").over(running))
    picked = join_null_safe(hit, targets, keys, "inner").where(
        (F.col("_cum") - F.col("_c") <= F.col("_local")) & (F.col("_local") < F.col("_cum"))
    )
    # One row per group: both ends and the position of every percentile.
    parts = []
    for i, n in enumerate(names):
        is_n = F.col("_name") == n
        parts += [
            F.max(F.when(is_n & (F.col("_end") == "lo"), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when(is_n & (F.col("_end") == "hi"), F.col("_v"))).alias(f"_hi{i}"),
            F.max(F.when(is_n, F.col("_h"))).alias(f"_h{i}"),
        ]
    ends_per = picked.groupBy(*G).agg(*parts)
    out = []
    for i, n in enumerate(names):
        lo, hi, h = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_h{i}")
        # the built-in's own interpolation, in its order of operations
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi).alias(n))
    return ends_per.select(*G, *out)


def group_stats(
    df: DataFrame,
    group_cols: Sequence[str],
    stats: Sequence[str] = BOX_STATS,
    value_col: str = "value_numeric",
    person_col: str = "person_id",
    dp: int = 2,
    approx: bool = False,
    accuracy: int = 10000,
    weight_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Box-plot statistics per group, doubles rounded to ``dp`` decimals.

    ``weight_col`` (optional) is a per-row multiplicity, for inputs that were
    pre-aggregated into (value, count) rows before a join: counts, mean,
    percentiles and standard deviation then weigh each row by it.

    Without percentiles this is one lazy aggregate. With them, rows are counted
    per (group, person, value) and written once (``frozen_slices``); every
    statistic is read from that copy, which ``scratch`` owns (default: the
    session's query scratch).

    ``approx=True`` is an opt-in for speed over exactness: percentiles from
    ``percentile_approx`` (a mergeable sketch, rank error about
    1/``accuracy``) and patients from ``approx_count_distinct``, all in one
    aggregate pass.
    """
    G = list(group_cols)
    pct = {s: PERCENTILE_STATS[s] for s in stats if s in PERCENTILE_STATS}
    if approx:
        if weight_col:
            raise ValueError("approx statistics take unweighted rows")
        return _approx_stats(df, G, stats, value_col, person_col, dp, accuracy)
    if not G and (pct or (weight_col and "std_dev" in stats)):
        # one group of all rows; no row at all still gives the row of a global aggregate
        one = group_stats(df.withColumn("__all", F.lit(0)), ["__all"], stats, value_col, person_col, dp, False, accuracy, weight_col, scratch)
        return one.agg(*[F.first(s).alias(s) if s not in COUNT_STATS else F.coalesce(F.first(s), F.lit(0)).alias(s) for s in stats])
    if pct:
        spark = df.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = frozen_slices(df, G, value_col, weight_col, scratch or query_scratch(spark), n, [person_col])
        df, value_col, weight_col = ranged, "_v", "_c"
    weighted_sd = bool(weight_col) and "std_dev" in stats
    v = F.col(value_col)
    if weight_col:
        w = F.col(weight_col)
        exprs = {
            "n_measurements": F.sum(w),
            "mean_value": F.sum(v * w) / F.sum(F.when(v.isNotNull(), w)),
        }
    else:
        exprs = {"n_measurements": F.count(F.lit(1)), "mean_value": F.avg(v), "std_dev": F.stddev_samp(v)}
    exprs.update({"n_patients": F.count_distinct(person_col), "min_value": F.min(v), "max_value": F.max(v)})
    basic_names = [s for s in stats if s in exprs] or ["n_measurements"]
    out = df.groupBy(*G).agg(*[exprs[s].alias(s) for s in basic_names])
    if pct:
        out = join_null_safe(out, sliced_percentiles(ranged, G, pct), G, "left")
    if weighted_sd:
        out = join_null_safe(out, _weighted_stddev(df, G, value_col, weight_col), G, "left")
    cols = []
    for s in stats:
        if s in COUNT_STATS:
            cols.append(F.col(s).cast("bigint").alias(s))
        else:
            cols.append(round_dp(F.col(s), dp).alias(s))
    return out.select(*G, *cols)


def _weighted_stddev(df: DataFrame, G, value_col: str, weight_col: str) -> DataFrame:
    """Sample standard deviation of count-weighted rows, two-pass (group
    mean first, then weighted squared deviations), so it stays as stable as
    the unweighted ``stddev_samp``. NULL for fewer than two rows."""
    v, w = F.col(value_col), F.col(weight_col)
    rows = df.where(v.isNotNull())
    means = rows.groupBy(*G).agg((F.sum(v * w) / F.sum(w)).alias("_mean"), F.sum(w).alias("_n"))
    dev = join_null_safe(rows, means, G, "inner")
    ss = dev.groupBy(*G).agg(
        F.sum(w * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_ss"), F.max("_n").alias("_n")
    )
    return ss.select(*G, F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1))).alias("std_dev"))


def _approx_stats(df, G, stats, value_col, person_col, dp, accuracy) -> DataFrame:
    exprs = {
        "n_measurements": F.count(F.lit(1)),
        "n_patients": F.approx_count_distinct(person_col),
        "mean_value": F.avg(value_col),
        "min_value": F.min(value_col),
        "max_value": F.max(value_col),
        "std_dev": F.stddev_samp(value_col),
    }
    for name, p in PERCENTILE_STATS.items():
        exprs[name] = F.percentile_approx(value_col, p, accuracy)
    aggs = [exprs[s].alias(s) for s in stats]
    out = df.groupBy(*G).agg(*aggs) if G else df.agg(*aggs)
    cols = [F.col(s).cast("bigint").alias(s) if s in COUNT_STATS else round_dp(F.col(s), dp).alias(s) for s in stats]
    return out.select(*G, *cols)
