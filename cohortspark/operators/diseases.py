"""Cohorts and outcomes of several diseases at once.

Every person is a case or a control of each disease. A person's memberships are
one row (an array of one entry per requested disease), so the measurement table
is joined once on the person, whatever the number of diseases; the entries are
unfolded after the join, where the date condition and the partial aggregates of
the reports follow at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_yyyymmdd
from ..sources import model
from .joins import salted_join
from .outcomes import _rows_per_person, positive_measurements


def memberships(
    person: DataFrame,
    condition: DataFrame,
    measurement: DataFrame,
    disease_ids: Iterable[int] = model.DISEASE_IDS,
    default_index_date: dt.date | None = model.DEFAULT_INDEX_DATE,
) -> DataFrame:
    """(person_id, members): members is array<struct<disease_concept_id, cohort,
    index_date>> with one entry per disease that the person is a case or (for
    persons of the person table) a control of."""
    ids = [int(i) for i in disease_ids]
    is_one = {i: F.col("condition_concept_id") == i for i in ids}
    cases = (
        condition.where(F.col("condition_concept_id").isin(ids) & F.col("person_id").isNotNull())
        .groupBy("person_id")
        .agg(
            *[F.min(F.when(is_one[i], F.col("condition_start_date"))).alias(f"_first_{i}") for i in ids],
            *[F.max(is_one[i].cast("int")).alias(f"_is_{i}") for i in ids],
        )
    )
    seen = measurement.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.min("measurement_date").alias("_seen"))
    listed = person.where(F.col("person_id").isNotNull()).select("person_id", F.lit(True).alias("_listed")).distinct()
    everyone = listed.join(cases, "person_id", "full").join(seen, "person_id", "left")
    default = F.lit(default_index_date).cast("date")
    control_index = F.coalesce(parse_yyyymmdd(F.col("_seen")), default)
    entries = []
    for i in ids:
        is_case = F.col(f"_is_{i}") == 1
        entry = F.struct(
            F.lit(i).alias("disease_concept_id"),
            F.when(is_case, model.CASE).otherwise(model.CONTROL).alias("cohort"),
            F.when(is_case, parse_yyyymmdd(F.col(f"_first_{i}"))).otherwise(control_index).alias("index_date"),
        )
        entries.append(F.when(is_case | F.col("_listed"), entry))
    return everyone.select("person_id", F.array_compact(F.array(*entries)).alias("members"))


def extract_measurements_by_disease(measurement: DataFrame, members: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Positive measurements on or after index, per disease: (disease_concept_id,
    cohort, person_id, cohort_index_date, measurement_date, measurement_concept_id,
    value_numeric)."""
    m = positive_measurements(measurement)
    joined = salted_join(m, members, "person_id", counts if counts is not None else _rows_per_person(m))
    on_time = F.filter("members", lambda e: F.col("measurement_date") >= e["index_date"])
    return joined.select("person_id", "measurement_date", "measurement_concept_id", "value_numeric", F.explode(on_time).alias("_m")).select(
        "_m.disease_concept_id",
        "_m.cohort",
        "person_id",
        F.col("_m.index_date").alias("cohort_index_date"),
        "measurement_date",
        "measurement_concept_id",
        "value_numeric",
    )
