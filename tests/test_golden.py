"""Golden rows at sf0.001 (cross-checked in two engines, see FIXTURES.md)."""

from pyspark.sql import functions as F

from cohortspark.plans.registry import study
from study_data import SF_SMALL


def test_golden_summary(spark):
    rows = {r.cohort: tuple(r)[1:] for r in study(spark, SF_SMALL).summary.collect()}
    assert rows["CASE"] == (1131, 122, 25.54, 26.0, 13.0, 38.0, 1.0, 50.0, 14.53)
    assert rows["CONTROL"] == (154, 16, 26.37, 25.5, 16.0, 38.0, 1.0, 50.0, 14.26)


def test_golden_profile(spark):
    rows = {r.cohort: tuple(r)[1:] for r in study(spark, SF_SMALL).profile.collect()}
    assert rows["CASE"] == (132, 49.4, 2, 88, 61, 66, 46.2)
    assert rows["CONTROL"] == (18, 44.1, 8, 81, 7, 11, 38.9)


def test_golden_disease_list(spark):
    rows = [tuple(r) for r in study(spark, SF_SMALL).disease_list().collect()]
    assert rows == [
        (201826, "Type 2 diabetes mellitus", 132),
        (312648, "Atrial fibrillation", 130),
        (320128, "Essential hypertension", 126),
        (432867, "Condition 432867", 126),
    ]


def test_golden_age_sex(spark):
    rows = sorted(tuple(r) for r in study(spark, SF_SMALL).by_age_sex.collect())
    assert len(rows) == 15
    assert rows[0] == ("CASE", "20-40", "Female", 12, 124, 27.49, 29.5)
    assert rows[1] == ("CASE", "20-40", "Male", 14, 201, 24.51, 23.0)
    assert rows[-2] == ("CONTROL", "60+", "Male", 2, 9, 26.89, 36.0)
    assert rows[-1] == ("CONTROL", "<20", "Female", 2, 37, 25.95, 25.0)


def test_golden_days_from_index(spark):
    r = study(spark, SF_SMALL).measurements.agg(
        F.sum("days_from_index"), F.min("days_from_index"), F.max("days_from_index")
    ).collect()[0]
    assert tuple(r) == (1275487, 0, 2459)
