"""Load checks: row counts and invariants of the study tables, as data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_yyyymmdd


def _check(frame: DataFrame, name: str, actual, expected) -> DataFrame:
    return frame.select(
        F.lit(name).alias("check"),
        actual.cast("bigint").alias("actual"),
        expected.cast("bigint").alias("expected"),
    )


def load_checks(
    person: DataFrame,
    condition: DataFrame,
    measurement: DataFrame,
    cases: DataFrame,
    controls: DataFrame,
    expected: Mapping[str, int | DataFrame] | None = None,
) -> DataFrame:
    """One row per check: (check, actual, expected, ok).

    ``expected`` may name the row counts that the tables ought to have
    (``person_rows``, ``condition_rows``, ``measurement_rows``), as numbers or as
    one-row frames; a table without an expectation gets no such row. Each check
    is a global aggregate (partial aggregation in every task, one small final
    merge); all checks are unioned into one frame.
    """
    no_id = F.count_if(F.col("person_id").isNull())
    persons = person.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("nd"), no_id.alias("nn"))
    undated = lambda c: F.count_if(parse_yyyymmdd(F.col(c), strict=False).isNull()).alias("nu")
    cond = condition.agg(F.count(F.lit(1)).alias("n"), no_id.alias("nn"), undated("condition_start_date"))
    meas = measurement.agg(F.count(F.lit(1)).alias("n"), no_id.alias("nn"), undated("measurement_date"))
    ids = lambda frame: frame.where(F.col("person_id").isNotNull()).select("person_id")
    members = cases.select("person_id").unionByName(controls.select("person_id"))
    count = F.count(F.lit(1)).alias("n")
    uncovered = ids(person).join(members, "person_id", "left_anti").agg(count)
    unknown = ids(cases).join(ids(person), "person_id", "left_anti").agg(count)
    overlap = ids(cases).join(ids(controls), "person_id", "left_semi").agg(count)
    rows = [
        _check(persons, "person_rows_unique", F.col("n"), F.col("nd")),
        _check(persons, "person_null_ids", F.col("nn"), F.lit(0)),
        _check(cond, "condition_null_ids", F.col("nn"), F.lit(0)),
        _check(cond, "condition_unparsed_dates", F.col("nu"), F.lit(0)),
        _check(meas, "measurement_null_ids", F.col("nn"), F.lit(0)),
        _check(meas, "measurement_unparsed_dates", F.col("nu"), F.lit(0)),
        _check(uncovered, "persons_in_no_cohort", F.col("n"), F.lit(0)),
        _check(unknown, "case_ids_not_in_person", F.col("n"), F.lit(0)),
        _check(overlap, "case_control_overlap", F.col("n"), F.lit(0)),
    ]
    counted = {"person_rows": persons, "condition_rows": cond, "measurement_rows": meas}
    for name, want in (expected or {}).items():
        value = want.scalar() if isinstance(want, DataFrame) else F.lit(int(want))
        rows.append(_check(counted[name], name, F.col("n"), value))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("ok", F.col("actual") == F.col("expected"))
