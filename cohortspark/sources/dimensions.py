"""Literal dimension frames (concept labels, analyte catalogue, bounds).

These frames have a fixed, proven size (a handful of rows defined in
``model``), so joining them with ``F.broadcast`` is always safe: they never
grow with the data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import model


def literal_frame(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """Literal rows as a local relation, whose exact size the planner knows (a
    frame made from Python rows has no size, and joins with it are shuffled)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def concept_frame(spark: SparkSession) -> DataFrame:
    """Concept id -> label dimension (inline VALUES source)."""
    return literal_frame(spark, model.CONCEPT_ROWS, model.CONCEPT_SCHEMA)


def catalogue_frame(spark: SparkSession) -> DataFrame:
    """Analyte catalogue: concept id, name, short name, unit."""
    return literal_frame(spark, model.MEASUREMENT_CATALOGUE_ROWS, model.CATALOGUE_SCHEMA)


def clamp_bounds_frame(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("cohort", T.StringType(), False),
            T.StructField("measurement_concept_id", T.IntegerType(), False),
            T.StructField("clamp_low", T.DoubleType(), False),
            T.StructField("clamp_high", T.DoubleType(), False),
        ]
    )
    return literal_frame(spark, model.CLAMP_BOUNDS_ROWS, schema)


def cohort_scaffold(spark: SparkSession) -> DataFrame:
    """Two-row frame of cohort tags, to keep empty cohorts in reports."""
    return literal_frame(spark, [(model.CASE, 0), (model.CONTROL, 1)], "cohort string, cohort_order int")


def age_band_scaffold(spark: SparkSession) -> DataFrame:
    """One row per age band with its display order."""
    rows = [(label, i + 1) for i, (label, _, _) in enumerate(model.AGE_BANDS)]
    return literal_frame(spark, rows, "age_group string, age_order int")


def id_list_frame(spark: SparkSession, ids, name: str) -> DataFrame:
    """A frame of requested ids (caller-sized, e.g. the diseases asked for)."""
    return literal_frame(spark, [(int(i),) for i in ids], f"{name} int")
