"""Operators on hand-built frames: the edge cases the fixtures lack."""

import datetime as dt

from pyspark.sql import functions as F

from cohortspark.operators import cohorts as C
from cohortspark.operators import demographics as D
from cohortspark.operators import outcomes as O
from cohortspark.operators import report as R
from cohortspark.operators import stats as S
from cohortspark.operators import stratify as T
from cohortspark.sources import model
from cohortspark.sources.dimensions import concept_frame

D1 = 201826


def frames(spark):
    person = spark.createDataFrame(
        [(1, 8507, 1950), (2, 8532, 1990), (3, 0, 2000), (4, 8507, 1980), (5, 8532, 1985)],
        model.PERSON_SCHEMA,
    )
    condition = spark.createDataFrame(
        [(1, D1, 20100105), (1, D1, 20090301), (2, D1, 20150101), (4, 320128, 20120101)],
        model.CONDITION_SCHEMA,
    )
    measurement = spark.createDataFrame(
        [
            (1, 3004501, 20090301, 5.0),  # on the index day: kept
            (1, 3004501, 20090228, 7.0),  # a day before: dropped
            (1, 3004501, 20090401, 0.0),  # zero: dropped
            (1, 3004501, 20090402, -1.0),  # negative: dropped
            (1, 3004501, 20090403, None),  # NULL: dropped
            (2, 3000963, 20150102, 10.0),
            (4, 3000963, 20110101, 3.0),  # control, first measurement = index
            (4, 3000963, 20130101, 4.0),
        ],
        model.MEASUREMENT_SCHEMA,
    )
    return person, condition, measurement


def test_case_cohort_first_diagnosis(spark):
    _, condition, _ = frames(spark)
    got = {r.person_id: r.index_date for r in C.case_cohort(condition, D1).collect()}
    assert got == {1: dt.date(2009, 3, 1), 2: dt.date(2015, 1, 1)}


def test_control_cohort_default_and_first_measurement(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    got = {r.person_id: r.index_date for r in C.control_cohort(person, case, measurement).collect()}
    assert got == {3: model.DEFAULT_INDEX_DATE, 4: dt.date(2011, 1, 1), 5: model.DEFAULT_INDEX_DATE}
    none = {r.person_id: r.index_date for r in C.control_cohort(person, case, measurement, None).collect()}
    assert none[3] is None and none[4] == dt.date(2011, 1, 1)


def test_cases_and_controls_partition_persons(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    control = C.control_cohort(person, case, measurement)
    cs = {r[0] for r in case.select("person_id").collect()}
    ct = {r[0] for r in control.select("person_id").collect()}
    assert not cs & ct
    assert cs | ct == {r[0] for r in person.select("person_id").collect()}


def test_not_in_ignores_null_ids_in_exclusion_list(spark):
    person, condition, _ = frames(spark)
    with_null = condition.unionByName(spark.createDataFrame([(None, D1, 20200101)], "person_id long, condition_concept_id int, condition_start_date int"))
    got = sorted(r[0] for r in C.not_in_cohort(person, with_null, D1).collect())
    assert got == [3, 4, 5]


def test_build_cohorts_counts_and_empty_disease(spark):
    person, condition, _ = frames(spark)
    rows = {r.disease_concept_id: r for r in C.build_cohorts(person, condition, [D1, 320128, 999]).collect()}
    assert (rows[D1].case_count, rows[D1].control_count) == (2, 3)
    assert (rows[320128].case_count, rows[320128].control_count) == (1, 4)
    assert (rows[999].case_count, rows[999].control_count) == (0, 5)
    assert rows[D1].case_label == "Disease" and rows[D1].control_label == "Non-disease"


def test_cohort_counts_keep_empty_cohort(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, 12345)  # nobody
    control = C.control_cohort(person, case, measurement)
    got = {r.cohort: r.n for r in C.cohort_counts(case, control).collect()}
    assert got == {"case": 0, "control": 5}


def test_extract_measurements_filters(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    cohorts = C.cohort_union(case, C.control_cohort(person, case, measurement))
    mc = O.extract_measurements(measurement, cohorts)
    got = sorted((r.person_id, r.value_numeric, r.days_from_index, r.cohort) for r in mc.collect())
    assert got == [(1, 5.0, 0, "CASE"), (2, 10.0, 1, "CASE"), (4, 3.0, 0, "CONTROL"), (4, 4.0, 731, "CONTROL")]


def test_demographics_unmapped_gender_and_profile(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    cohorts = C.cohort_union(case, C.control_cohort(person, case, measurement))
    demog = D.demographics(cohorts, person, concept_frame(spark))
    g = {r.person_id: (r.gender, r.age_at_index) for r in demog.collect()}
    assert g[3] == (None, 1970 - 2000)  # unmapped gender, negative age
    assert g[1] == ("Male", 2009 - 1950)
    prof = {r.cohort: r for r in D.demographic_profile(demog).collect()}
    assert (prof["CASE"].n_patients, prof["CASE"].n_male, prof["CASE"].n_female) == (2, 1, 1)
    assert prof["CASE"].pct_male == 50.0
    # unmapped gender counts in neither sex, so percentages need not total 100
    assert (prof["CONTROL"].n_male, prof["CONTROL"].n_female) == (1, 1)
    assert prof["CONTROL"].pct_male == 33.3


def test_profile_of_empty_cohort(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, 12345)
    cohorts = C.cohort_union(case, C.control_cohort(person, case, measurement))
    demog = D.demographics(cohorts, person, concept_frame(spark))
    prof = {r.cohort: r for r in D.demographic_profile(demog).collect()}
    assert prof["CASE"].n_patients == 0 and prof["CASE"].pct_male is None and prof["CASE"].mean_age is None
    rep = {r.cohort: r for r in D.demographic_report(demog).collect()}
    assert rep["CASE"].pct_male == 0.0


def test_single_row_stddev_is_null(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 1.0), ("B", 2, 3.0)], "cohort string, person_id long, value_numeric double")
    got = {r.cohort: r for r in S.group_stats(df, ["cohort"]).collect()}
    assert got["A"].std_dev is None and got["A"].median_value == 2.0
    assert got["B"].std_dev == 1.41 and got["B"].median_value == 2.0 and got["B"].p25 == 1.5


def test_disease_list_fallback_and_order(spark):
    _, condition, _ = frames(spark)
    concept = spark.createDataFrame([(D1, "Type 2 diabetes mellitus"), (320128, "")], model.CONCEPT_SCHEMA)
    rows = R.disease_list(condition, concept, [D1, 320128]).collect()
    assert [(r.concept_id, r.name, r.patient_count) for r in rows] == [
        (D1, "Type 2 diabetes mellitus", 2),
        (320128, "Condition 320128", 1),
    ]


def test_sample_is_ordered_and_limited(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    cohorts = C.cohort_union(case, C.control_cohort(person, case, measurement))
    mc = O.extract_measurements(measurement, cohorts)
    rows = T.measurement_sample(mc, 3).collect()
    assert [(r.cohort, r.person_id) for r in rows] == [("CASE", 1), ("CASE", 2), ("CONTROL", 4)]


def test_pivot_zero_fill(spark):
    person, condition, measurement = frames(spark)
    case = C.case_cohort(condition, D1)
    cohorts = C.cohort_union(case, C.control_cohort(person, case, measurement))
    demog = D.demographics(cohorts, person, concept_frame(spark))
    mc = O.extract_measurements(measurement, cohorts)
    rows = {r.age_group: r for r in R.age_sex_pivot(mc, person, concept_frame(spark)).collect()}
    assert set(rows) == {"<20", "20-40", "40-60", "60+"}
    # person 1: case, male, 59 at index; person 2: case, female, 25; person 4: control, male, 31
    got = {k: (r.case_male, r.case_female, r.control_male, r.control_female) for k, r in rows.items()}
    assert got == {"<20": (0, 0, 0, 0), "20-40": (0, 1, 1, 0), "40-60": (1, 0, 0, 0), "60+": (0, 0, 0, 0)}


def test_every_load_check_can_fail(spark):
    from cohortspark.operators.checks import load_checks

    person = spark.createDataFrame([(1,), (1,), (None,), (5,)], "person_id long")
    condition = spark.createDataFrame([(1, 20200101), (None, 20200230)], "person_id long, condition_start_date int")
    measurement = spark.createDataFrame([(1, None), (None, 20200101)], "person_id long, measurement_date int")
    cases = spark.createDataFrame([(1,), (9,)], "person_id long")
    controls = spark.createDataFrame([(1,)], "person_id long")
    wrong = {"person_rows": 3, "condition_rows": condition.agg(F.lit(7)), "measurement_rows": 1}
    got = {r.check: r for r in load_checks(person, condition, measurement, cases, controls, wrong).collect()}
    assert len(got) == 12 and not any(r.ok for r in got.values()), got
    assert got["case_ids_not_in_person"].actual == 1 and got["condition_rows"].expected == 7
    assert "person_rows" not in {r.check for r in load_checks(person, condition, measurement, cases, controls).collect()}


def test_controls_by_subtraction_with_case_ids_not_in_person(spark):
    person, condition, _ = frames(spark)
    extra = spark.createDataFrame([(77, D1, 20100101)], model.CONDITION_SCHEMA)
    rows = {r.disease_concept_id: r for r in C.build_cohorts(person.union(person), condition.union(extra), [D1]).collect()}
    assert (rows[D1].case_count, rows[D1].control_count) == (3, 3)
