"""Demographics at index: age, gender label, cohort profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import age_band
from ..functions.numeric import percent, round_dp
from ..sources import model
from ..sources.dimensions import cohort_scaffold


def gender_labels(person: DataFrame, concept: DataFrame) -> DataFrame:
    """Person with the label of its gender concept (NULL when unmapped).

    No broadcast hint: the built-in concept dimension is a local relation
    whose exact size lets the planner broadcast it (the person side then
    never moves on its three gender values), while a full user-supplied
    concept table is only broadcast if its size passes the planner's threshold.
    """
    labels = concept.select(F.col("concept_id").alias("gender_concept_id"), F.col("concept_name").alias("gender"))
    return person.join(labels, "gender_concept_id", "left")


def cohort_persons(cohorts: DataFrame, person: DataFrame) -> DataFrame:
    """Tagged cohort members joined to their person row."""
    return cohorts.join(person, "person_id", "inner").select(
        "cohort", "person_id", "index_date", "gender_concept_id", "year_of_birth"
    )


def demographics(cohorts: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Age at index (calendar-year difference) and gender label per member.

    Runs once over the tagged union of both cohorts.
    """
    members = gender_labels(cohort_persons(cohorts, person), concept)
    return members.select(
        "cohort",
        "person_id",
        "index_date",
        "gender_concept_id",
        "gender",
        "year_of_birth",
        (F.year("index_date") - F.col("year_of_birth")).cast("int").alias("age_at_index"),
    )


def ages(cohorts: DataFrame, person: DataFrame) -> DataFrame:
    """Age at index per member, without the gender label."""
    age = (F.year("index_date") - F.col("year_of_birth")).cast("int")
    return cohort_persons(cohorts, person).select("cohort", "person_id", age.alias("age_at_index"))


def age_bands(demog: DataFrame) -> DataFrame:
    return demog.select("cohort", "person_id", "age_at_index", age_band(F.col("age_at_index")).alias("age_group"))


def _is(label: str):
    return F.col("gender") == F.lit(label)


def demographic_profile(demog: DataFrame) -> DataFrame:
    """n, mean/min/max age, male/female counts and % male per cohort.

    One aggregate over both cohorts (two groups, partial aggregation does the
    work map-side); an empty cohort still yields its row via the scaffold.
    """
    agg = demog.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.avg("age_at_index").alias("_mean_age"),
        F.min("age_at_index").alias("min_age"),
        F.max("age_at_index").alias("max_age"),
        F.count_if(_is(model.MALE_LABEL)).alias("n_male"),
        F.count_if(_is(model.FEMALE_LABEL)).alias("n_female"),
    )
    scaffold = cohort_scaffold(demog.sparkSession).select("cohort")
    n = F.coalesce(F.col("n_patients"), F.lit(0)).cast("bigint")
    n_male = F.coalesce(F.col("n_male"), F.lit(0)).cast("bigint")
    return scaffold.join(agg, "cohort", "left").select(
        "cohort",
        n.alias("n_patients"),
        round_dp(F.col("_mean_age"), 1).alias("mean_age"),
        F.col("min_age").cast("int").alias("min_age"),
        F.col("max_age").cast("int").alias("max_age"),
        n_male.alias("n_male"),
        F.coalesce(F.col("n_female"), F.lit(0)).cast("bigint").alias("n_female"),
        percent(n_male, n, 1).alias("pct_male"),
    )


def profile_display(profile: DataFrame, disease_label: str = model.DISEASE_SHORT_LABEL) -> DataFrame:
    """The profile under its display labels, 'CASE (Diabetes)' and 'CONTROL (No Diabetes)'."""
    case = F.col("cohort") == model.CASE
    text = F.when(case, f"{model.CASE} ({disease_label})").otherwise(f"{model.CONTROL} (No {disease_label})")
    return profile.select(text.alias("cohort_label"), *[c for c in profile.columns if c != "cohort"])


def gender_counts(demog: DataFrame) -> DataFrame:
    return demographic_profile(demog).select("cohort", "n_male", "n_female")


def pct_male(demog: DataFrame) -> DataFrame:
    return demographic_profile(demog).select("cohort", "pct_male")


def demographic_report(demog: DataFrame) -> DataFrame:
    """Service form of the profile: no age range, % male 0 for an empty cohort."""
    return demographic_profile(demog).select(
        "cohort",
        "n_patients",
        "mean_age",
        "n_male",
        "n_female",
        F.coalesce(F.col("pct_male"), F.lit(0.0)).alias("pct_male"),
    )
