"""Plan shape: anti joins, broadcasts of fixed dimensions, pushdown, no UDFs."""

import os
import re
import tempfile
import uuid

import pytest

from cohortspark.operators import cohorts as C
from cohortspark.operators import outcomes as O
from cohortspark.plans.registry import PERCENTILE, QUERIES, STORED, study
from cohortspark.session import query_scratch
from study_data import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_control_cohort_is_left_anti_not_null_aware(spark):
    s = study(spark, SF_SMALL)
    p = plan(s.control)
    assert "LeftAnti" in p
    assert "isnull" not in p.lower().replace("isnotnull", "")  # no outer-join + IS NULL form
    p2 = plan(QUERIES["not_in_cohort"](spark, SF_SMALL))
    assert "LeftAnti" in p2 and "NullAware" not in p2 and "BroadcastNestedLoopJoin" not in p2


GENDER_QUERIES = ["gender_labels", "demographics", "demographic_profile", "demographic_report", "gender_counts", "pct_male",
                  "profile_display", "age_at_index", "age_bands", "age_sex_pivot"]


@pytest.mark.parametrize("key", GENDER_QUERIES)
def test_persons_never_move_on_their_gender(spark, key):
    """Three gender values: a shuffle on them would put all persons in three tasks."""
    p = plan(QUERIES[key](spark, SF_SMALL))
    assert not re.search(r"hashpartitioning\(gender_concept_id", p)
    joins = [line for line in p.split("\n") if "Join" in line and "gender_concept_id" in line]
    if key in ("age_at_index", "age_bands"):
        assert not joins
    else:
        assert joins and all("BroadcastHashJoin" in j for j in joins)


def test_age_sex_input_never_moves_on_gender(spark):
    from cohortspark.operators.stratify import with_age_band_and_gender

    s = study(spark, SF_SMALL)
    rows = s.measurements.select("cohort", "person_id", "cohort_index_date", "value_numeric")
    p = plan(with_age_band_and_gender(rows, s.t.person, s.t.concept))
    assert "hashpartitioning(gender_concept_id" not in p and re.search(r"BroadcastHashJoin \[gender_concept_id", p)


def jobs_of(spark, build):
    """Number of Spark jobs that building starts."""
    group = f"build-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
    finally:
        spark.sparkContext.setJobGroup("none", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


FOOTERS = 4  # customer, orders (twice) and lineitem


@pytest.mark.parametrize("key", sorted(set(QUERIES) - PERCENTILE - STORED - {"measurement_seq"}))
def test_building_a_query_only_reads_footers(spark, key):
    most = 2 * FOOTERS if key == "load_checks" else FOOTERS
    assert jobs_of(spark, lambda: QUERIES[key](spark, SF_SMALL)) <= most


def test_building_statistics_writes_one_copy(spark):
    # one write: the range partitioning's sample and the write itself, each with
    # the stages of one outcome join
    for key in sorted(PERCENTILE):
        before = len(query_scratch(spark).paths)
        QUERIES[key](spark, SF_SMALL)
        assert len(query_scratch(spark).paths) - before == 1, key


def test_registering_views_runs_no_job(spark):
    s = study(spark, SF_SMALL)
    assert jobs_of(spark, lambda: s.register_views(prefix="lazy_", reports=False)) == 0


def test_no_python_in_any_query_plan(spark):
    for key, fn in QUERIES.items():
        if key.startswith("scan_csv"):
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, key


def test_stats_have_no_expand_and_no_single_task_sort(spark):
    p = plan(study(spark, SF_SMALL).summary)
    assert "Expand" not in p
    assert "SinglePartition" not in p


def test_filters_pushed_and_columns_pruned(spark, tables):
    path = os.path.join(tempfile.mkdtemp(prefix="cohortspark-plan-"), "m")
    tables.measurement.write.parquet(path)
    m = spark.read.parquet(path)
    p = plan(O.positive_measurements(m).select("person_id", "value_numeric"))
    assert "PushedFilters: [IsNotNull(value_as_number), GreaterThan(value_as_number,0.0)]" in p
    assert "ReadSchema: struct<person_id:bigint,value_as_number:double>" in p
    c = spark.read.parquet(path).withColumnRenamed("measurement_concept_id", "condition_concept_id")
    p2 = plan(C.case_cohort(c.withColumnRenamed("measurement_date", "condition_start_date"), 3004501))
    assert "EqualTo(measurement_concept_id,3004501)" in p2 or "In(measurement_concept_id" in p2
