"""Schemas, fixed dimension values and study defaults.

Everything a study reads is described here once: the normalised input
schemas (what the operators expect, whatever the source format), and the
handful of literal dimension rows the study needs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Normalised input schemas (column names are what every operator uses).
# Dates arrive as yyyymmdd integers in the clinical extracts; they are parsed
# once, at the operator that needs a DATE.
# --------------------------------------------------------------------------

PERSON_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("gender_concept_id", T.IntegerType(), True),
        T.StructField("year_of_birth", T.IntegerType(), True),
    ]
)

CONDITION_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("condition_concept_id", T.IntegerType(), False),
        T.StructField("condition_start_date", T.IntegerType(), True),
    ]
)

MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType(), False),
        T.StructField("measurement_concept_id", T.IntegerType(), True),
        T.StructField("measurement_date", T.IntegerType(), True),
        T.StructField("value_as_number", T.DoubleType(), True),
    ]
)

CONCEPT_SCHEMA = T.StructType(
    [
        T.StructField("concept_id", T.IntegerType(), False),
        T.StructField("concept_name", T.StringType(), True),
    ]
)

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("concept_id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("short_name", T.StringType(), False),
        T.StructField("unit", T.StringType(), False),
    ]
)

# --------------------------------------------------------------------------
# Fixed values. These must equal the original study's values for results to
# agree; they are listed plainly and in their natural order.
# --------------------------------------------------------------------------

# Condition and gender concept labels.
CONCEPT_ROWS = [
    (201826, "Type 2 diabetes mellitus"),
    (320128, "Essential hypertension"),
    (312648, "Atrial fibrillation"),
    (432867, "Nausea"),
    (8507, "Male"),
    (8532, "Female"),
]

# Disease choices offered by the study.
DISEASE_IDS = [201826, 320128, 312648, 432867]

# Measurement catalogue: concept id, full name, short name, unit.
MEASUREMENT_CATALOGUE_ROWS = [
    (3000963, "Hemoglobin [Mass/volume] in Blood", "Hemoglobin", "g/dL"),
    (3004501, "Glucose [Mass/volume] in Serum or Plasma", "Glucose", "mg/dL"),
    (3012888, "Diastolic blood pressure", "DBP", "mmHg"),
    (3004249, "Systolic blood pressure", "SBP", "mmHg"),
]

# Gender labels counted by the profile (a label test, not a concept test).
MALE_LABEL = "Male"
FEMALE_LABEL = "Female"

# Cohort tags.
CASE = "CASE"
CONTROL = "CONTROL"

# Disease name in the profile's display labels.
DISEASE_SHORT_LABEL = "Diabetes"

# Labels of the cohort-count endpoint.
CASE_LABEL = "Disease"
CONTROL_LABEL = "Non-disease"

# Age bands: label, inclusive lower bound, exclusive upper bound.
AGE_BANDS = [
    ("<20", None, 20),
    ("20-40", 20, 40),
    ("40-60", 40, 60),
    ("60+", 60, None),
]

# Per-cohort, per-analyte clamp bounds (cohort, concept id, low, high).
CLAMP_BOUNDS_ROWS = [
    ("CASE", 3000963, 9.0, 16.0),
    ("CASE", 3004501, 80.0, 400.0),
    ("CASE", 3012888, 65.0, 110.0),
    ("CASE", 3004249, 110.0, 180.0),
    ("CONTROL", 3000963, 11.0, 17.0),
    ("CONTROL", 3004501, 65.0, 130.0),
    ("CONTROL", 3012888, 60.0, 90.0),
    ("CONTROL", 3004249, 95.0, 140.0),
]

# Share of controls kept by the control sample.
CONTROL_SAMPLE_RATE = 0.2

# Study defaults.
DEFAULT_DISEASE_ID = 201826
DEFAULT_INDEX_DATE = _dt.date(1970, 1, 1)
SAMPLE_ROWS = 20
