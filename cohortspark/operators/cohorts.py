"""Case / control cohort construction.

All joins here are keyed on ``person_id``; Spark hash-partitions each side on
it once and the chained joins reuse that partitioning. Each cohort frame has
one row per person (per input person row), so the joins are many-to-one and
a person with very many events only weighs on the pre-aggregated side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_yyyymmdd
from ..sources import model
from ..sources.dimensions import id_list_frame, literal_frame


def _ids(disease_ids) -> list[int]:
    if isinstance(disease_ids, int):
        return [disease_ids]
    return [int(i) for i in disease_ids]


def case_cohort(condition: DataFrame, disease_ids=model.DEFAULT_DISEASE_ID) -> DataFrame:
    """Persons with any of the conditions; index date = first diagnosis.

    MIN is taken on the raw yyyymmdd integer (which sorts like the date) and
    only the one winning value per person is parsed.
    """
    return (
        condition.where(F.col("condition_concept_id").isin(_ids(disease_ids)))
        .groupBy("person_id")
        .agg(F.min("condition_start_date").alias("_first"))
        .select("person_id", parse_yyyymmdd(F.col("_first")).alias("index_date"))
    )


def first_event(events: DataFrame, date_col: str = "measurement_date") -> DataFrame:
    """Earliest event date per person (partial aggregation map-side)."""
    return (
        events.groupBy("person_id")
        .agg(F.min(date_col).alias("_first"))
        .select("person_id", parse_yyyymmdd(F.col("_first")).alias("index_date"))
    )


def measurement_activity(measurement: DataFrame) -> DataFrame:
    """Per person: first measurement date (parsed) and number of rows.

    One partial aggregation over the measurement table serving two needs:
    the control index date and the row counts that decide which persons are
    salted in the outcome join.
    """
    return (
        measurement.groupBy("person_id")
        .agg(F.min("measurement_date").alias("_first"), F.count(F.lit(1)).alias("n_rows"))
        .select("person_id", parse_yyyymmdd(F.col("_first")).alias("index_date"), "n_rows")
    )


def non_case_persons(person: DataFrame, cases: DataFrame) -> DataFrame:
    """Persons not in the case cohort (a true anti join, not outer + IS NULL)."""
    return person.join(cases.select("person_id"), "person_id", "left_anti")


def control_index_dates(
    person: DataFrame,
    cases: DataFrame,
    measurement: DataFrame,
    default_index_date: dt.date | None = model.DEFAULT_INDEX_DATE,
    activity: DataFrame | None = None,
) -> DataFrame:
    """Non-case persons with their first measurement date and resolved index.

    ``activity`` (optional) is a precomputed ``measurement_activity`` frame,
    so a study that needs the per-person measurement aggregate elsewhere
    computes it once.
    """
    first_frame = activity.select("person_id", "index_date") if activity is not None else first_event(measurement)
    first = first_frame.withColumnRenamed("index_date", "first_measurement_date")
    default = F.lit(default_index_date) if default_index_date is not None else F.lit(None).cast("date")
    return (
        non_case_persons(person.select("person_id"), cases)
        .join(first, "person_id", "left")
        .select(
            "person_id",
            "first_measurement_date",
            F.coalesce(F.col("first_measurement_date"), default).alias("index_date"),
            F.col("first_measurement_date").isNull().alias("index_defaulted"),
        )
    )


def control_cohort(
    person: DataFrame,
    cases: DataFrame,
    measurement: DataFrame,
    default_index_date: dt.date | None = model.DEFAULT_INDEX_DATE,
    activity: DataFrame | None = None,
) -> DataFrame:
    """Everyone not a case; index = first measurement, else the default date."""
    return control_index_dates(person, cases, measurement, default_index_date, activity).select(
        "person_id", "index_date"
    )


def cohort_union(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Both cohorts in one frame, tagged, so later steps run once for both."""
    return cases.select(F.lit(model.CASE).alias("cohort"), "person_id", "index_date").unionByName(
        controls.select(F.lit(model.CONTROL).alias("cohort"), "person_id", "index_date")
    )


def cohort_counts(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Size of each cohort; an empty cohort still reports 0."""
    spark = cases.sparkSession
    counts = (
        cases.select(F.lit("case").alias("cohort"))
        .unionByName(controls.select(F.lit("control").alias("cohort")))
        .groupBy("cohort")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scaffold = literal_frame(spark, [("case",), ("control",)], "cohort string")
    return scaffold.join(counts, "cohort", "left").select(
        "cohort", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")
    )


def distinct_case_persons(condition: DataFrame, disease_ids=model.DEFAULT_DISEASE_ID) -> DataFrame:
    """The distinct person ids carrying the condition."""
    return condition.where(F.col("condition_concept_id").isin(_ids(disease_ids))).select("person_id").distinct()


def not_in_cohort(person: DataFrame, condition: DataFrame, disease_ids=model.DEFAULT_DISEASE_ID) -> DataFrame:
    """Persons whose id is not in the condition's person list.

    SQL's NOT IN turns NULL for everyone once the list holds a NULL id; here
    NULL ids are removed from the list first (they are reported by
    ``load_checks``), and the exclusion is a shuffle-able anti join rather
    than the null-aware form Spark must broadcast.
    """
    excluded = distinct_case_persons(condition, disease_ids).where(F.col("person_id").isNotNull())
    return person.where(F.col("person_id").isNotNull()).select("person_id").join(excluded, "person_id", "left_anti")


def build_cohorts(person: DataFrame, condition: DataFrame, disease_ids: Iterable[int] = model.DISEASE_IDS) -> DataFrame:
    """Case and control counts for several diseases in one job.

    case_count = distinct persons with the condition; control_count = distinct
    persons of the person table less those of them in that set (a semi join on
    person, whose rows are the cases, not persons x diseases). No person set is
    ever collected or broadcast.
    """
    ids = _ids(disease_ids)
    spark = person.sparkSession
    pairs = (
        condition.where(F.col("condition_concept_id").isin(ids) & F.col("person_id").isNotNull())
        .select(F.col("condition_concept_id").alias("disease_concept_id"), "person_id")
        .distinct()
    )
    case_counts = pairs.groupBy("disease_concept_id").agg(F.count(F.lit(1)).alias("case_count"))
    persons = person.where(F.col("person_id").isNotNull()).select("person_id")
    present = (
        pairs.join(persons, "person_id", "left_semi")
        .groupBy("disease_concept_id")
        .agg(F.count(F.lit(1)).alias("present_count"))
    )
    n_persons = persons.agg(F.count_distinct("person_id")).scalar()
    requested = id_list_frame(spark, ids, "disease_concept_id")
    # The count frames hold at most one row per requested id.
    return (
        requested.join(case_counts, "disease_concept_id", "left")
        .join(present, "disease_concept_id", "left")
        .select(
            "disease_concept_id",
            F.coalesce("case_count", F.lit(0)).cast("bigint").alias("case_count"),
            F.lit(model.CASE_LABEL).alias("case_label"),
            (n_persons - F.coalesce("present_count", F.lit(0))).cast("bigint").alias("control_count"),
            F.lit(model.CONTROL_LABEL).alias("control_label"),
        )
    )
