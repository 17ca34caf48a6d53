"""Stratified reports: age band x sex, analyte counts, ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import age_band, age_band_order
from ..functions.numeric import round_dp
from ..session import Scratch
from ..sources import model
from .stats import group_stats

AGE_SEX_STATS = ["n_patients", "n_measurements", "mean_value", "median_value"]


VALUE_STATS = {"mean_value", "median_value", "p25", "p75", "min_value", "max_value", "std_dev"}


def with_age_band_and_gender(rows: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Rows carrying (cohort, person_id, cohort_index_date) get the member's
    age band and gender label at index; rows lacking either are left out.

    The join is on ``person_id`` alone; the person side (one row per person,
    gender label from the concept dimension, broadcast by the planner when
    its size allows) is the side that moves.
    """
    labels = concept.select(F.col("concept_id").alias("gender_concept_id"), F.col("concept_name").alias("gender"))
    p = person.select("person_id", "gender_concept_id", "year_of_birth").join(labels, "gender_concept_id", "left")
    age = (F.year("cohort_index_date") - F.col("year_of_birth")).cast("int")
    keep = [c for c in rows.columns if c not in ("cohort_index_date",)]
    return (
        rows.join(p, "person_id", "inner")
        .where(age.isNotNull() & F.col("gender").isNotNull())
        .select(*keep, age_band(age).alias("age_group"), "gender")
    )


def measurement_by_age_sex(
    mc: DataFrame,
    person: DataFrame,
    concept: DataFrame,
    stats: Sequence[str] = AGE_SEX_STATS,
    scratch: Scratch | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Patients, measurements, mean and median by cohort x age band x gender (and
    by the columns of ``by`` before them).

    Outcome rows are first collapsed to (cohort, person, index date, value)
    with a row count -- map-side, so even a person owning a large share of
    all rows reaches the join as a handful of rows per task (a hot person's
    rows look alike after pruning, so byte-based skew detection alone would
    not catch them). Only the value-free key is kept when no value
    statistic is asked for. The statistics then weigh each row by its count.
    """
    keys = [*by, "cohort", "person_id", "cohort_index_date"]
    if VALUE_STATS & set(stats):
        keys.append("value_numeric")
    pre = mc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if "value_numeric" not in keys:
        pre = pre.withColumn("value_numeric", F.lit(None).cast("double"))
    rows = with_age_band_and_gender(pre, person, concept)
    return group_stats(rows, [*by, "cohort", "age_group", "gender"], stats=list(stats), weight_col="_rows", scratch=scratch)


def age_bands_ordered(by_age_sex: DataFrame) -> DataFrame:
    """The stratified report in display order: cohort, band ordinal (so '<20'
    comes first, not after '60+' as in lexical order), gender."""
    return by_age_sex.withColumn("age_order", age_band_order(F.col("age_group"))).orderBy(
        "cohort", "age_order", F.col("gender").asc_nulls_last()
    )


def measurement_type_counts(mc: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows, patients and mean (1 dp) per cohort x analyte, with short name.

    The catalogue is a fixed literal dimension, broadcast after the
    aggregate has reduced the data to one row per (cohort, analyte).
    """
    agg = mc.groupBy("cohort", "measurement_concept_id").agg(
        F.count(F.lit(1)).alias("n_measurements"),
        F.count_distinct("person_id").alias("n_patients"),
        F.avg("value_numeric").alias("_mean"),
    )
    names = catalogue.select(
        F.col("concept_id").alias("measurement_concept_id"), F.col("short_name").alias("measurement_name")
    )
    return agg.join(F.broadcast(names), "measurement_concept_id", "left").select(
        "cohort",
        "measurement_concept_id",
        "measurement_name",
        "n_measurements",
        "n_patients",
        round_dp(F.col("_mean"), 1).alias("mean_value"),
    )


SAMPLE_ORDER = [
    "cohort",
    "person_id",
    "measurement_date",
    "measurement_concept_id",
    "value_numeric",
    "value_as_number",
    "cohort_index_date",
    "days_from_index",
]


def measurement_sample(mc: DataFrame, n: int = model.SAMPLE_ROWS) -> DataFrame:
    """First n rows by cohort, person, date; the remaining columns break ties.

    ORDER BY + LIMIT plans as TakeOrderedAndProject: each task keeps its own
    top n and only n rows per task reach the final merge.
    """
    return mc.orderBy(*[F.col(c).asc_nulls_last() for c in SAMPLE_ORDER]).limit(n)
