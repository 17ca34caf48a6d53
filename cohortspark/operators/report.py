"""Selectors and chart-ready report frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import grouped_int, label_or_fallback, plain_number, with_unit
from ..sources import model
from ..sources.dimensions import age_band_scaffold
from .stratify import measurement_by_age_sex


def patients_per_concept(condition: DataFrame) -> DataFrame:
    """Distinct patients per condition concept (exact distinct count).

    Spark plans the distinct count as a (concept, person) pre-aggregation
    first, so one very common concept is spread over many tasks.
    """
    return condition.groupBy("condition_concept_id").agg(F.count_distinct("person_id").alias("n_patients"))


def disease_list(
    condition: DataFrame, concept: DataFrame, disease_ids: Iterable[int] = model.DISEASE_IDS
) -> DataFrame:
    """Patients per offered disease with its label, most common first.

    Counts first, then the label join on the few aggregated rows (the
    planner broadcasts whichever side its size check allows); a missing or
    empty label falls back to 'Condition <id>'.
    """
    ids = [int(i) for i in disease_ids]
    counts = (
        condition.where(F.col("condition_concept_id").isin(ids))
        .groupBy(F.col("condition_concept_id").alias("concept_id"))
        .agg(F.count_distinct("person_id").alias("patient_count"))
    )
    # only the requested labels: a filter that reaches a parquet concept
    # table's scan and leaves a side bounded by the request
    labels = concept.where(F.col("concept_id").isin(ids))
    labelled = counts.join(labels, "concept_id", "left")
    return labelled.select(
        "concept_id",
        label_or_fallback(F.col("concept_name"), F.col("concept_id")).alias("name"),
        "patient_count",
    ).orderBy(F.desc("patient_count"), "concept_id")


def disease_options(diseases: DataFrame) -> DataFrame:
    """Selector entries: 'name (n patients)'."""
    return diseases.select(
        "concept_id",
        F.concat(F.col("name"), F.lit(" ("), F.col("patient_count").cast("string"), F.lit(" patients)")).alias(
            "option_label"
        ),
    )


def cohort_cards(counts: DataFrame, concept: DataFrame, disease_id: int = model.DEFAULT_DISEASE_ID) -> DataFrame:
    """Display texts of the two cohorts, from ``cohorts.cohort_counts``: label,
    count with thousands separators, description."""
    name = concept.where(F.col("concept_id") == int(disease_id)).select(F.max("concept_name")).scalar()
    disease = label_or_fallback(name, F.lit(int(disease_id)))
    case = F.col("cohort") == "case"
    return counts.select(
        "cohort",
        F.when(case, f"{model.CASE} ({model.CASE_LABEL})").otherwise(f"{model.CONTROL} ({model.CONTROL_LABEL})").alias("label"),
        grouped_int(F.col("n")).alias("count_text"),
        F.concat(F.when(case, "Patients with ").otherwise("Patients without "), disease).alias("description"),
    )


PIVOT_COLUMNS = [
    ("case_male", model.CASE, model.MALE_LABEL),
    ("case_female", model.CASE, model.FEMALE_LABEL),
    ("control_male", model.CONTROL, model.MALE_LABEL),
    ("control_female", model.CONTROL, model.FEMALE_LABEL),
]


def age_sex_pivot(mc: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Long -> wide: one row per age band, patients per cohort x sex, 0 filled.

    Only the patient counts are computed (no medians). The conditional sums
    run over at most bands x cohorts x genders aggregated rows; the four-row
    band scaffold keeps empty bands.
    """
    counts = measurement_by_age_sex(mc, person, concept, stats=["n_patients"])
    wide = counts.groupBy("age_group").agg(
        *[
            F.sum(F.when((F.col("cohort") == c) & (F.col("gender") == g), F.col("n_patients"))).alias(name)
            for name, c, g in PIVOT_COLUMNS
        ]
    )
    scaffold = age_band_scaffold(mc.sparkSession)
    return scaffold.join(wide, "age_group", "left").select(
        "age_group",
        "age_order",
        *[F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name, _, _ in PIVOT_COLUMNS],
    )


def box_plot(summary: DataFrame, concept: DataFrame, disease_id: int = model.DEFAULT_DISEASE_ID) -> DataFrame:
    """Five-number record per cohort with its display label.

    The disease name is one value of the concept dimension, attached as a
    scalar subquery (evaluated once), not as a join.
    """
    name = concept.where(F.col("concept_id") == int(disease_id)).select(F.max("concept_name")).scalar()
    disease = label_or_fallback(name, F.lit(int(disease_id)))
    label = F.when(
        F.col("cohort") == model.CASE, F.concat(F.lit(model.CASE_LABEL + " ("), disease, F.lit(")"))
    ).otherwise(F.lit(model.CONTROL_LABEL))
    return summary.select("cohort", label.alias("label"), "min_value", "p25", "median_value", "p75", "max_value")


def summary_card(summary_by_concept: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Display strings per cohort x analyte: counts with thousands
    separators, values with the analyte's unit, 'min - max unit' range."""
    units = catalogue.select(F.col("concept_id").alias("measurement_concept_id"), "unit")
    s = summary_by_concept.join(F.broadcast(units), "measurement_concept_id", "left")
    u = F.col("unit")
    return s.select(
        "cohort",
        "measurement_concept_id",
        grouped_int(F.col("n_patients")).alias("n_patients_text"),
        grouped_int(F.col("n_measurements")).alias("n_measurements_text"),
        with_unit(plain_number(F.col("median_value")), u).alias("median_text"),
        with_unit(plain_number(F.col("p25")), u).alias("p25_text"),
        with_unit(plain_number(F.col("p75")), u).alias("p75_text"),
        with_unit(plain_number(F.col("mean_value")), u).alias("mean_text"),
        with_unit(
            F.concat(plain_number(F.col("min_value")), F.lit(" - "), plain_number(F.col("max_value"))), u
        ).alias("range_text"),
    )
