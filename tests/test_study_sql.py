"""SQL surface: temp views, bound parameters, the derived-table build."""

from cohortspark.plans.registry import study
from cohortspark.sources.sinks import require_table
from study_data import SF_SMALL


def test_views_and_bound_parameters(spark):
    s = study(spark, SF_SMALL)
    s.register_views(prefix="v_")
    q = """SELECT COUNT(DISTINCT person_id) AS n FROM v_condition_occurrence
           WHERE condition_concept_id = :disease"""
    n = spark.sql(q, args={"disease": 201826}).collect()[0].n
    assert n == s.case.count() == 132
    rows = spark.sql("SELECT cohort, n_patients FROM v_measurement_summary ORDER BY cohort").collect()
    assert [(r.cohort, r.n_patients) for r in rows] == [("CASE", 122), ("CONTROL", 16)]


def test_build_tables_bucketed(spark):
    s = study(spark, SF_SMALL)
    built = s.build_tables(prefix="t_", buckets=4)
    for name in built.values():
        require_table(spark, name)
    assert spark.table("t_measurement_summary").count() == 2
    assert spark.table("t_measurements_combined").count() == 1285
    # joining two tables bucketed on person_id needs no shuffle (size-based
    # broadcast is switched off so the bucketed sort-merge join is chosen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_demographics_case").join(spark.table("t_cohort_case"), "person_id")
        p = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert j.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in built.values():
        spark.sql(f"DROP TABLE {name}")


def test_analyte_filter_honoured(spark):
    s = study(spark, SF_SMALL, measurement_concept_id=3004501)
    concepts = {r[0] for r in s.measurements.select("measurement_concept_id").distinct().collect()}
    assert concepts == {3004501}
    by_concept = {
        (r.cohort, r.measurement_concept_id): r
        for r in study(spark, SF_SMALL).summary_by_concept.collect()
    }
    for r in s.summary.collect():
        assert tuple(r)[1:] == tuple(by_concept[(r.cohort, 3004501)])[2:]


def test_reports_from_stored_tables(spark):
    import json

    import pytest

    from cohortspark.plans.stored import stored_by_age_sex, stored_demographics, stored_summary
    from cohortspark.sources.sinks import MissingTableError

    with pytest.raises(MissingTableError):
        stored_summary(spark, prefix="nothing_built_")
    s = study(spark, SF_SMALL)
    built = s.build_tables(prefix="r_")
    recs = [json.loads(r.record) for r in stored_summary(spark, "r_").collect()]
    assert [r["cohort"] for r in recs] == ["CASE", "CONTROL"]
    assert recs[0]["median"] == 26.0 and recs[0]["n_measurements"] == 1131 and "mean_value" not in recs[0]
    bands = [(r.cohort, r.age_group) for r in stored_by_age_sex(spark, "r_").collect()]
    assert bands[0] == ("CASE", "<20") and bands[-1][1] == "60+"
    demo = {r.cohort: r for r in stored_demographics(spark, "r_").collect()}
    assert (demo["CASE"].n_patients, demo["CASE"].n_male, demo["CASE"].pct_male) == (132, 61, 46.2)
    for name in built.values():
        spark.sql(f"DROP TABLE {name}")
