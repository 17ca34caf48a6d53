"""Full batch build from CSV extracts, checked against the lazy study."""

import os
import tempfile

from cohortspark.plans.build import build
from cohortspark.plans.registry import study
from cohortspark.sources import csv as CSV
from study_data import SF_SMALL


def test_build_from_csv_extract(spark, tables):
    src = tempfile.mkdtemp(prefix="cohortspark-extract-")
    CSV.write_table_csv(tables.person, os.path.join(src, "person"))
    CSV.write_table_csv(tables.condition, os.path.join(src, "condition_occurrence"), compression="bzip2")
    CSV.write_table_csv(tables.measurement, os.path.join(src, "measurement"))
    out = tempfile.mkdtemp(prefix="cohortspark-export-")
    built = build(spark, src, "csv", prefix="b_", buckets=4, export=out)
    want = sorted(tuple(r) for r in study(spark, SF_SMALL).summary.collect())
    got = sorted(tuple(r) for r in spark.table(built["measurement_summary"]).collect())
    assert got == want
    assert sorted(os.listdir(out)) == ["age_sex_pivot", "box_plot", "summary_card"]
    for name in built.values():
        spark.sql(f"DROP TABLE {name}")


def test_parquet_extract_with_dates_and_row_ids(spark, tables):
    from pyspark.sql import functions as F

    from cohortspark.sources.extract import load_extract

    src = tempfile.mkdtemp(prefix="cohortspark-pq-")
    tables.person.toDF(*[c.upper() for c in tables.person.columns]).write.parquet(os.path.join(src, "person"))
    tables.condition.write.parquet(os.path.join(src, "condition_occurrence"))
    # measurement dates stored as real DATE values this time
    m = tables.measurement.drop("measurement_row").withColumn(
        "measurement_date", F.to_date(F.col("measurement_date").cast("string"), "yyyyMMdd"))
    m.write.parquet(os.path.join(src, "measurement"))
    t = load_extract(spark, src, "parquet")
    assert "measurement_row" in t.measurement.columns
    n = t.measurement.count()
    assert t.measurement.select("measurement_row").distinct().count() == n
    want = sorted(tables.measurement.drop("measurement_row").collect())
    assert sorted(t.measurement.drop("measurement_row").collect()) == want
    assert sorted(t.person.collect()) == sorted(tables.person.collect())


def test_build_joins_the_outcomes_once(spark, tables, monkeypatch):
    """Plans that are written or exported, and how many of them scan the
    measurement extract: the per-person aggregate and the outcome table."""
    from cohortspark.plans import build as B
    from cohortspark.plans import study as P
    from cohortspark.session import Scratch
    from cohortspark.sources import sinks

    src = tempfile.mkdtemp(prefix="cohortspark-once-")
    tables.person.write.parquet(os.path.join(src, "person"))
    tables.condition.write.parquet(os.path.join(src, "condition_occurrence"))
    tables.measurement.drop("measurement_row").write.parquet(os.path.join(src, "measurement"))
    scans = []

    def counted(real, at):
        def call(*args, **kw):
            plan = args[at]._jdf.queryExecution().executedPlan().toString()
            scans.append(sum("FileScan" in line and "value_as_number" in line for line in plan.split("\n")))
            return real(*args, **kw)

        return call

    monkeypatch.setattr(sinks, "save_table", counted(sinks.save_table, 0))
    monkeypatch.setattr(B, "export_frame", counted(B.export_frame, 0))
    monkeypatch.setattr(Scratch, "materialize", counted(Scratch.materialize, 1))
    built = B.build(spark, src, "parquet", prefix="once_", buckets=2, export=tempfile.mkdtemp(prefix="cohortspark-once-out-"))
    assert sum(scans) == 1
    assert P.Study is B.Study
    for name in built.values():
        spark.sql(f"DROP TABLE {name}")
