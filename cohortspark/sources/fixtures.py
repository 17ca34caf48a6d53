"""Study input views derived from the supplied TPC-H-shaped tables.

The supplied parquet tables hold no clinical data, so the four study inputs
are derived from customer / orders / lineitem with a fixed mapping:

* person      <- customer
* condition   <- orders (priority picks the condition concept)
* measurement <- lineitem joined to its finished order
* concept     <- literal dimension (one condition label deliberately absent)

Only the columns each view needs are read, so the parquet scan is pruned to
them, and the order-status filter is pushed into the orders scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import concept_frame

# Fixed values of the derivation (mapping tables of the fixture).
PRIORITY_TO_CONDITION = [
    ("1-URGENT", 201826),
    ("2-HIGH", 320128),
    ("3-MEDIUM", 312648),
    ("4-NOT SPECIFIED", 432867),
]
LINENUMBER_MOD4_TO_ANALYTE = [(0, 3000963), (1, 3004501), (2, 3012888), (3, 3004249)]
UNMAPPED_GENDER_NATION = 24
FIXTURE_CONCEPT_IDS = [201826, 320128, 312648, 8507, 8532]


def int_date(c: Column) -> Column:
    """yyyymmdd integer of a date/timestamp column (the clinical extract form)."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def _lookup(key: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def person_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    gender = (
        F.when(F.col("c_nationkey") == UNMAPPED_GENDER_NATION, F.lit(0))
        .when(F.col("c_nationkey") % 2 == 0, F.lit(8507))
        .otherwise(F.lit(8532))
    )
    return c.select(
        F.col("c_custkey").alias("person_id"),
        gender.cast("int").alias("gender_concept_id"),
        (F.lit(1910) + F.col("c_custkey") % 85).cast("int").alias("year_of_birth"),
    )


def condition_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    return o.select(
        F.col("o_custkey").alias("person_id"),
        _lookup(F.col("o_orderpriority"), PRIORITY_TO_CONDITION, 0)
        .cast("int")
        .alias("condition_concept_id"),
        int_date(F.col("o_orderdate")).alias("condition_start_date"),
    )


def scan_row_id() -> Column:
    """A deterministic id per scanned parquet row (file path, row index):
    stable across task retries and, unlike ``monotonically_increasing_id``,
    no obstacle to filter pushdown."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def measurement_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate",
        scan_row_id().alias("measurement_row"),
    )
    o = (
        read_table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select("o_orderkey", "o_custkey")
    )
    value = (
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
        .when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity"))
    )
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        F.col("o_custkey").alias("person_id"),
        _lookup(F.col("l_linenumber") % 4, LINENUMBER_MOD4_TO_ANALYTE)
        .cast("int")
        .alias("measurement_concept_id"),
        int_date(F.col("l_shipdate")).alias("measurement_date"),
        value.cast("double").alias("value_as_number"),
        "measurement_row",
    )


def fixture_concept(spark: SparkSession) -> DataFrame:
    return concept_frame(spark).where(F.col("concept_id").isin(FIXTURE_CONCEPT_IDS))


@dataclass(frozen=True)
class StudyTables:
    """The four study inputs, as lazy DataFrames."""

    person: DataFrame
    condition: DataFrame
    measurement: DataFrame
    concept: DataFrame


def load_study(spark: SparkSession, sf_dir: str) -> StudyTables:
    return StudyTables(
        person=person_view(spark, sf_dir),
        condition=condition_view(spark, sf_dir),
        measurement=measurement_view(spark, sf_dir),
        concept=fixture_concept(spark),
    )


# SQL text of the same four views, for the DuckDB oracle (independent of the
# DataFrame code above). Valid in DuckDB against the supplied table names.
ORACLE_VIEWS_SQL = """
person AS (
  SELECT c_custkey AS person_id,
         CAST(CASE WHEN c_nationkey = 24 THEN 0
                   WHEN c_nationkey % 2 = 0 THEN 8507
                   ELSE 8532 END AS INTEGER) AS gender_concept_id,
         CAST(1910 + c_custkey % 85 AS INTEGER) AS year_of_birth
  FROM customer
),
condition_occurrence AS (
  SELECT o_custkey AS person_id,
         CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 201826
                                   WHEN '2-HIGH' THEN 320128
                                   WHEN '3-MEDIUM' THEN 312648
                                   WHEN '4-NOT SPECIFIED' THEN 432867
                                   ELSE 0 END AS INTEGER) AS condition_concept_id,
         CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER)
           AS condition_start_date
  FROM orders
),
measurement AS (
  SELECT o.o_custkey AS person_id,
         CAST(CASE l.l_linenumber % 4 WHEN 0 THEN 3000963 WHEN 1 THEN 3004501
                                      WHEN 2 THEN 3012888 WHEN 3 THEN 3004249 END AS INTEGER)
           AS measurement_concept_id,
         CAST(year(l.l_shipdate) * 10000 + month(l.l_shipdate) * 100 + day(l.l_shipdate) AS INTEGER)
           AS measurement_date,
         CAST(CASE WHEN l.l_tax = 0 THEN NULL
                   WHEN l.l_discount = 0 THEN 0.0
                   ELSE l.l_quantity END AS DOUBLE) AS value_as_number
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderstatus = 'F'
),
concept AS (
  SELECT * FROM (VALUES
    (201826, 'Type 2 diabetes mellitus'),
    (320128, 'Essential hypertension'),
    (312648, 'Atrial fibrillation'),
    (8507, 'Male'),
    (8532, 'Female')
  ) AS t(concept_id, concept_name)
)"""
