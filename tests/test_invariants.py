"""Invariants: partition-count independence, cohort laws, report sanity."""

import pytest

from cohortspark.plans.registry import QUERIES
from study_data import SF_SMALL

REPEATABLE = ["control_sample", "keyed_uniform", "measurement_seq",
              "measurement_summary", "clamped_values"]


@pytest.mark.parametrize("key", REPEATABLE)
def test_same_result_for_1_and_64_partitions(spark, key):
    results = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(sorted(tuple(r) for r in QUERIES[key](spark, SF_SMALL).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_report_invariants(spark):
    summary = QUERIES["measurement_summary"](spark, SF_SMALL).collect()
    for r in summary:
        assert r.min_value <= r.p25 <= r.median_value <= r.p75 <= r.max_value
        assert r.min_value > 0
    pivot = QUERIES["age_sex_pivot"](spark, SF_SMALL).collect()
    by = QUERIES["measurement_by_age_sex"](spark, SF_SMALL).collect()
    total = sum(r.n_patients for r in by if r.gender in ("Male", "Female"))
    assert total == sum(r.case_male + r.case_female + r.control_male + r.control_female for r in pivot)
    dfi = QUERIES["days_from_index"](spark, SF_SMALL).agg({"days_from_index": "min"}).collect()[0][0]
    assert dfi >= 0
    checks = QUERIES["load_checks"](spark, SF_SMALL).collect()
    assert all(r.ok for r in checks), [tuple(r) for r in checks if not r.ok]
