"""Outcome extraction: measurements of cohort members on or after index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, parse_yyyymmdd
from .joins import ROW_ID, salted_join


def parsed_measurements(measurement: DataFrame) -> DataFrame:
    """Measurement rows with a DATE and a DOUBLE value column (the scan's
    per-row id is carried along when the source has one)."""
    extra = [ROW_ID] if ROW_ID in measurement.columns else []
    return measurement.select(
        "person_id",
        "measurement_concept_id",
        parse_yyyymmdd(F.col("measurement_date")).alias("measurement_date"),
        "value_as_number",
        F.col("value_as_number").cast("double").alias("value_numeric"),
        *extra,
    )


def _rows_per_person(m: DataFrame) -> DataFrame:
    return m.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_rows"))


def positive_measurements(measurement: DataFrame) -> DataFrame:
    """Rows with a numeric value > 0 (NULL, zero and negative dropped).

    The predicate sits right above the scan, so on parquet it is pushed into
    the reader (``PushedFilters``).
    """
    return parsed_measurements(
        measurement.where(F.col("value_as_number").isNotNull() & (F.col("value_as_number").cast("double") > 0))
    )


def post_index_measurements(measurement: DataFrame, cohorts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Every measurement of a cohort member dated on or after the index date.

    Equi-join on person_id (salted for persons with very many rows, see
    ``joins.salted_join``) with the date comparison as the join's residual
    condition (evaluated inside the join, no intermediate all-dates frame).
    """
    m = parsed_measurements(measurement)
    c = cohorts.select("cohort", "person_id", F.col("index_date").alias("cohort_index_date"))
    joined = salted_join(m, c, "person_id", counts if counts is not None else _rows_per_person(m))
    return joined.where(F.col("measurement_date") >= F.col("cohort_index_date")).drop(ROW_ID)


def extract_measurements(measurement: DataFrame, cohorts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The analysis table: positive values on/after index, both cohorts.

    One join over the tagged cohort union; persons are in exactly one cohort,
    so each measurement row appears at most once. A person with very many
    rows (even exact copies) is split by row count across several join
    tasks (``joins.salted_join``); AQE's byte-based skew splitting remains as
    a second line. ``counts`` (person_id, n_rows) may come from an aggregate
    the caller already has (any upper bound of the rows per person works);
    otherwise it is computed here.
    """
    m = positive_measurements(measurement)
    c = cohorts.select("cohort", "person_id", F.col("index_date").alias("cohort_index_date"))
    return (
        salted_join(m, c, "person_id", counts if counts is not None else _rows_per_person(m))
        .where(F.col("measurement_date") >= F.col("cohort_index_date"))
        .select(
            "person_id",
            "cohort_index_date",
            "measurement_date",
            "measurement_concept_id",
            "value_as_number",
            "value_numeric",
            days_between(F.col("measurement_date"), F.col("cohort_index_date")).alias("days_from_index"),
            "cohort",
        )
    )
