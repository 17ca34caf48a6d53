"""CSV sources (header / positional / bzip2), sinks and the table guard."""

import os
import tempfile

import pytest

from cohortspark.sources import csv as CSV
from cohortspark.sources.sinks import MissingTableError, export_frame, json_records, require_table, save_table


def _tmp():
    return tempfile.mkdtemp(prefix="cohortspark-src-")


def test_csv_round_trip_upper_case_header_bzip2(spark, tables):
    path = os.path.join(_tmp(), "m")
    CSV.write_table_csv(tables.measurement, path, compression="bzip2")
    assert any(f.endswith(".bz2") for f in os.listdir(path))
    back = CSV.read_table_csv(spark, path, "measurement")
    source = tables.measurement.drop("measurement_row")
    assert [f.dataType for f in back.schema] == [f.dataType for f in source.schema]
    assert sorted(back.collect()) == sorted(tables.measurement.drop("measurement_row").collect())


def test_csv_inferred_schema_opt_in(spark, tables):
    path = os.path.join(_tmp(), "p")
    CSV.write_table_csv(tables.person, path)
    back = CSV.read_table_csv(spark, path, "person", infer_schema=True)
    assert back.count() == tables.person.count()


def test_malformed_cells_become_null(spark):
    path = os.path.join(_tmp(), "bad.csv")
    with open(path, "w") as f:
        f.write("PERSON_ID,MEASUREMENT_CONCEPT_ID,MEASUREMENT_DATE,VALUE_AS_NUMBER,EXTRA\n")
        f.write("1,3004501,20200101,abc,x\n2,3004501,20200102,4.5,y\n")
    rows = sorted(CSV.read_table_csv(spark, path, "measurement").collect())
    assert rows[0].value_as_number is None and rows[1].value_as_number == 4.5


def test_positional_round_trip(spark, tables):
    path = os.path.join(_tmp(), "pos")
    CSV.write_measurement_positional(tables.measurement, path)
    back = CSV.read_measurement_positional(spark, path)
    assert back.columns == ["person_id", "measurement_concept_id", "measurement_date", "value_as_number"]
    assert sorted(back.collect()) == sorted(tables.measurement.drop("measurement_row").collect())


def test_table_guard_and_save(spark, tables):
    with pytest.raises(MissingTableError):
        require_table(spark, "no_such_table_here", "build the cohorts first")
    save_table(tables.person, "person_bucketed_test", bucket_by="person_id", buckets=4)
    require_table(spark, "person_bucketed_test")
    assert spark.table("person_bucketed_test").count() == tables.person.count()
    spark.sql("DROP TABLE person_bucketed_test")


def test_json_records_and_export(spark):
    df = spark.createDataFrame([("CASE", 1.5, 2)], "cohort string, mean_value double, n long")
    rec = json_records(df, {"mean_value": "mean"}, keep=["cohort"]).collect()[0]
    assert rec.cohort == "CASE" and rec.record == '{"cohort":"CASE","mean":1.5,"n":2}'
    with_null = spark.createDataFrame([("A", None)], "cohort string, std_dev double")
    assert json_records(with_null).collect()[0].record == '{"cohort":"A","std_dev":null}'
    for fmt in ("csv", "json", "parquet"):
        out = os.path.join(_tmp(), fmt)
        export_frame(df, out, fmt)
        assert any(not f.startswith(".") and not f.startswith("_") for f in os.listdir(out))


def test_dates_normalised_from_any_form(spark):
    import datetime as dt

    from cohortspark.sources.csv import conform
    from cohortspark.sources.model import MEASUREMENT_SCHEMA

    as_date = spark.createDataFrame(
        [(1, 3004501, dt.date(2020, 1, 2), 4.0), (2, 3004501, None, 5.0)],
        "PERSON_ID long, MEASUREMENT_CONCEPT_ID int, MEASUREMENT_DATE date, VALUE_AS_NUMBER double",
    )
    as_text = spark.createDataFrame(
        [(1, "3004501", "20200102", "4.0"), (2, "3004501", "2020-01-03", "x"), (3, "3004501", "bad", "1")],
        "person_id long, measurement_concept_id string, measurement_date string, value_as_number string",
    )
    a = [tuple(r) for r in conform(as_date, MEASUREMENT_SCHEMA).orderBy("person_id").collect()]
    b = [tuple(r) for r in conform(as_text, MEASUREMENT_SCHEMA).orderBy("person_id").collect()]
    assert a == [(1, 3004501, 20200102, 4.0), (2, 3004501, None, 5.0)]
    assert b == [(1, 3004501, 20200102, 4.0), (2, 3004501, 20200103, None), (3, 3004501, None, 1.0)]


def _files(folder, **texts):
    os.makedirs(folder)
    for name, text in texts.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write(text)
    return folder


def test_files_with_columns_in_different_order(spark):
    path = _files(
        os.path.join(_tmp(), "person"),
        a="PERSON_ID,GENDER_CONCEPT_ID,YEAR_OF_BIRTH\n1,8507,1950\n",
        b="\ufeffyear_of_birth,extra,person_id,gender_concept_id\n1960,x,2,8532\n",
        c="person_id,gender_concept_id,year_of_birth\n3,0,1970\n",
        d="",
    )
    want = [(1, 8507, 1950), (2, 8532, 1960), (3, 0, 1970)]
    assert sorted(map(tuple, CSV.read_table_csv(spark, path, "person").collect())) == want
    assert sorted(map(tuple, CSV.read_table_csv(spark, path + "/*.csv", "person", infer_schema=True).collect())) == want


def test_missing_or_repeated_column_is_an_error(spark):
    path = _files(os.path.join(_tmp(), "p"), a="person_id,gender_concept_id,year_of_birth\n1,2,3\n", b="person_id,year_of_birth\n1,2\n")
    with pytest.raises(ValueError, match="gender_concept_id"):
        CSV.read_table_csv(spark, path, "person")
    path = _files(os.path.join(_tmp(), "q"), a="person_id,person_id,gender_concept_id,year_of_birth\n1,1,2,3\n")
    with pytest.raises(ValueError, match="more than once"):
        CSV.read_table_csv(spark, path, "person")


def test_folder_without_rows(spark):
    path = _files(os.path.join(_tmp(), "empty"), a="")
    assert CSV.read_table_csv(spark, path, "person").count() == 0


def test_positional_dates_in_any_form(spark):
    path = _files(os.path.join(_tmp(), "pos"), a="1,7,3004501,2020-01-05,,,,4.5\n2,7,3004501,20200106,,,,5.5\n3,7,3004501,soon,,,,6.5\n")
    got = sorted((r.value_as_number, r.measurement_date) for r in CSV.read_measurement_positional(spark, path).collect())
    assert got == [(4.5, 20200105), (5.5, 20200106), (6.5, None)]


def test_row_ids_tell_rows_of_all_files_apart(spark):
    header = "person_id,measurement_concept_id,measurement_date,value_as_number\n"
    row = "1,3004501,20200101,2.5\n"
    path = _files(os.path.join(_tmp(), "m"), a=header + row * 50, b=header.upper() + row * 50, c="value_as_number," + header.replace(",value_as_number", "") + "2.5,1,3004501,20200101\n" * 50)
    rows = CSV.read_table_csv(spark, path, "measurement", row_id=True)
    assert rows.count() == rows.select("measurement_row").distinct().count() == 150
