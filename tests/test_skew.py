"""A person holding a third of all measurements: AQE splits the join."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import outcomes as O


def test_outcome_join_splits_hot_person(spark):
    hot = spark.range(0, 60000).select(F.lit(1).cast("long").alias("person_id"), F.col("id"))
    rest = spark.range(0, 120000).select((F.col("id") % 2000 + 2).alias("person_id"), F.col("id"))
    measurement = hot.unionByName(rest).select(
        "person_id",
        F.lit(3004501).alias("measurement_concept_id"),
        (F.lit(20200102) + F.col("id") % 20).cast("int").alias("measurement_date"),
        # varied values: the hot partition must be large in shuffle bytes too
        (F.abs(F.xxhash64("id")) % 100000 / 7.0 + 1).cast("double").alias("value_as_number"),
    )
    cohorts = spark.range(1, 2002).select(
        F.lit("CASE").alias("cohort"), F.col("id").alias("person_id"), F.lit(dt.date(2020, 1, 1)).alias("index_date")
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = O.extract_measurements(measurement, cohorts)
        n = df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert n == 180000
    assert "isSkewJoin=true" in final or "skew=true" in final, final[:3000]


def test_age_sex_report_preaggregates_hot_person(spark):
    """A person owning a third of the rows reaches the demographic join as a
    few pre-aggregated rows (map-side), and the report equals brute force."""
    from cohortspark.operators.stratify import measurement_by_age_sex
    from cohortspark.sources.dimensions import concept_frame

    hot = spark.range(0, 60000).select(F.lit(1).cast("long").alias("person_id"), F.col("id"))
    rest = spark.range(0, 120000).select((F.col("id") % 2000 + 2).alias("person_id"), F.col("id"))
    mc = hot.unionByName(rest).select(
        F.lit("CASE").alias("cohort"),
        "person_id",
        F.lit(dt.date(2020, 1, 1)).alias("cohort_index_date"),
        (F.col("id") % 40 + 1).cast("double").alias("value_numeric"),
    )
    person = spark.range(1, 2002).select(
        F.col("id").alias("person_id"),
        F.when(F.col("id") % 2 == 0, 8507).otherwise(8532).cast("int").alias("gender_concept_id"),
        (F.lit(1950) + F.col("id") % 50).cast("int").alias("year_of_birth"),
    )
    report = measurement_by_age_sex(mc, person, concept_frame(spark))
    got = sorted(tuple(r) for r in report.collect())

    # brute force on every row
    from cohortspark.functions.bands import age_band
    from cohortspark.functions.numeric import round_dp

    labels = concept_frame(spark).select(F.col("concept_id").alias("gender_concept_id"),
                                         F.col("concept_name").alias("gender"))
    rows = mc.join(person, "person_id").join(labels, "gender_concept_id").select(
        "cohort", age_band((F.lit(2020) - F.col("year_of_birth")).cast("int")).alias("age_group"), "gender",
        "person_id", "value_numeric")
    want = sorted(tuple(r) for r in rows.groupBy("cohort", "age_group", "gender").agg(
        F.count_distinct("person_id").cast("bigint"), F.count(F.lit(1)).cast("bigint"),
        round_dp(F.avg("value_numeric"), 2), round_dp(F.median("value_numeric"), 2)).collect())
    assert got == want

    # what reaches the join for the hot person: one row per distinct value
    pre = mc.groupBy("cohort", "person_id", "cohort_index_date", "value_numeric").count()
    assert pre.where(F.col("person_id") == 1).count() == 40


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_hot_person_of_identical_copies_is_salted(spark, fmt):
    """Exact copies compress to nothing, so byte-based skew detection misses
    them; the count-based salt still spreads them over several tasks."""
    import tempfile

    from cohortspark.operators.joins import ROWS_PER_SALT_CONF
    from cohortspark.sources.csv import read_table_csv
    from cohortspark.sources.fixtures import scan_row_id

    path = tempfile.mkdtemp(prefix="cohortspark-copies-") + "/m"
    copies = spark.range(0, 60000).select(
        F.lit(1).cast("long").alias("person_id"), F.lit(3004501).alias("measurement_concept_id"),
        F.lit(20200105).alias("measurement_date"), F.lit(7.5).alias("value_as_number"))
    rest = spark.range(0, 120000).select(
        (F.col("id") % 2000 + 2).alias("person_id"), F.lit(3004501).alias("measurement_concept_id"),
        (F.lit(20200102) + F.col("id") % 20).cast("int").alias("measurement_date"),
        (F.col("id") % 50 + 1).cast("double").alias("value_as_number"))
    all_rows = copies.unionByName(rest).repartition(8)
    if fmt == "csv":
        all_rows.write.option("header", True).csv(path)
        m = read_table_csv(spark, path, "measurement", row_id=True)
    else:
        all_rows.write.parquet(path)
        m = spark.read.parquet(path).withColumn("measurement_row", scan_row_id())
    cohorts = spark.range(1, 2002).select(
        F.lit("CASE").alias("cohort"), F.col("id").alias("person_id"), F.lit(dt.date(2020, 1, 1)).alias("index_date"))

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in list(conf) + [ROWS_PER_SALT_CONF]}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        biggest = {}
        for per_salt in ("1000000000", "5000"):
            spark.conf.set(ROWS_PER_SALT_CONF, per_salt)
            mc = O.extract_measurements(m, cohorts)
            sizes = mc.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in sizes) == 180000
            biggest[per_salt] = max(r["count"] for r in sizes)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert biggest["1000000000"] >= 60000  # unsalted: all copies in one task
    assert biggest["5000"] < 30000  # salted: spread over ~12 tasks
