"""Reports served from the stored derived tables (after ``build_tables``).

Each function checks that its table exists (a clear error otherwise), reads
only the columns it serves, orders rows for display and renames columns for
the consumer's JSON records. The tables are small aggregates, so these are
cheap reads; the heavy work happened once in the build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import age_band_order
from ..operators.demographics import demographic_report
from ..sources.sinks import json_records, require_table

SUMMARY_COLUMNS = ["cohort", "n_measurements", "n_patients", "mean_value", "median_value", "p25", "p75",
                   "min_value", "max_value", "std_dev"]
SUMMARY_RENAMES = {"mean_value": "mean", "median_value": "median", "min_value": "min", "max_value": "max"}
AGE_SEX_COLUMNS = ["cohort", "age_group", "gender", "n_patients", "n_measurements", "mean_value", "median_value"]


def stored_summary(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Box-plot statistics per cohort as JSON records, ordered by cohort."""
    name = prefix + "measurement_summary"
    require_table(spark, name, "build the study tables first")
    rows = spark.table(name).select(*SUMMARY_COLUMNS).orderBy("cohort")
    return json_records(rows, SUMMARY_RENAMES, keep=["cohort"])


def stored_by_age_sex(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The age band x sex report in display order (band ordinal, not text)."""
    name = prefix + "measurement_by_age_sex"
    require_table(spark, name, "build the study tables first")
    rows = spark.table(name).select(*AGE_SEX_COLUMNS)
    return rows.orderBy("cohort", age_band_order(F.col("age_group")), F.col("gender").asc_nulls_last())


def stored_demographics(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Demographic profile per cohort (service form) from the stored tables."""
    case, control = prefix + "demographics_case", prefix + "demographics_control"
    for name in (case, control):
        require_table(spark, name, "build the study tables first")
    cols = ["person_id", "age_at_index", "gender"]
    demog = (
        spark.table(case).select(F.lit("CASE").alias("cohort"), *cols)
        .unionByName(spark.table(control).select(F.lit("CONTROL").alias("cohort"), *cols))
    )
    return demographic_report(demog).orderBy("cohort")
