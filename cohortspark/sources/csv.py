"""CSV ingest of the study tables (with a header, or positional).

Clinical extracts arrive as CSV, sometimes bzip2-compressed (Hadoop's codec
reads ``*.bz2`` directly and splits it). Columns are matched by header name,
case-insensitively and file by file: an extract of several files may order its
columns differently in each, so files are grouped by their header line and each
group is read under its own. A file without a required column is an error.
Cells are cast to the declared schema with ``try_cast`` so a malformed cell
becomes NULL instead of failing a whole job. Schema inference is an opt-in (it
costs a full extra pass over the input).
"""

from __future__ import annotations

import csv as _csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model

SCHEMAS = {
    "person": model.PERSON_SCHEMA,
    "condition_occurrence": model.CONDITION_SCHEMA,
    "measurement": model.MEASUREMENT_SCHEMA,
    "concept": model.CONCEPT_SCHEMA,
}

# Positional layout of a headerless measurement extract (0-based column
# numbers, fixed values): id, person, concept, date, ..., value.
MEASUREMENT_POSITIONS = {
    "measurement_id": 0,
    "person_id": 1,
    "measurement_concept_id": 2,
    "measurement_date": 3,
    "value_as_number": 7,
}
MEASUREMENT_WIDTH = 8


DATE_COLUMNS = {"condition_start_date", "measurement_date"}


def yyyymmdd(c, dtype: T.DataType):
    """A date column of any common form as a yyyymmdd integer.

    DATE / TIMESTAMP values convert directly; text may be 'yyyymmdd' or
    'yyyy-MM-dd'; anything else becomes NULL rather than failing the job.
    """
    def as_int(d):
        return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")

    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return as_int(c)
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        return (
            F.when(text.rlike(r"^[0-9]{8}$"), text.try_cast("int"))
            .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), as_int(F.try_to_date(text, "yyyy-MM-dd")))
        )
    return c.try_cast("int")


def conform(raw: DataFrame, schema: T.StructType, keep=()) -> DataFrame:
    """Lower-case the header names, keep the schema's columns, cast them
    (dates normalised to yyyymmdd integers whatever their source form);
    columns named in ``keep`` pass through unchanged."""
    lowered = raw.toDF(*[c.strip().lower() for c in raw.columns])
    types = {f.name: f.dataType for f in lowered.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name in DATE_COLUMNS and isinstance(f.dataType, T.IntegerType):
            cols.append(yyyymmdd(F.col(f.name), types[f.name]).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    cols += [F.col(c) for c in keep if c in types]
    return lowered.select(*cols)


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Lower-cased column names of one CSV file, from its first line. The file is
    opened by Hadoop's FileSystem on the driver, like a file footer, through the
    codec that its name tells."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    conf = jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    raw = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
    try:
        line = lines.readLine()
    finally:
        lines.close()
    names = next(_csv.reader([line.lstrip("\ufeff")])) if line else []
    return tuple(n.strip().lower() for n in names)


def read_table_csv(
    spark: SparkSession, path: str, table: str, infer_schema: bool = False, row_id: bool = False
) -> DataFrame:
    """A study table from CSV with a header row, from a file, a folder or a glob.

    ``row_id`` adds ``measurement_row``, an id per scanned row."""
    schema = SCHEMAS[table]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file in spark.read.text(path).inputFiles():
        if header := header_of(spark, file):  # an empty file holds no rows
            layouts.setdefault(header, []).append(file)
    if not layouts:
        return spark.createDataFrame([], _with_row_id(schema) if row_id else schema)
    parts = []
    for header, files in sorted(layouts.items()):
        missing = [f.name for f in schema.fields if f.name not in header]
        if missing:
            raise ValueError(f"{table}: {', '.join(missing)} not in the header of {files[0]}")
        twice = sorted({n for n in header if header.count(n) > 1} & set(schema.names))
        if twice:
            raise ValueError(f"{table}: {', '.join(twice)} more than once in the header of {files[0]}")
        reader = spark.read.option("header", True)
        if infer_schema:
            raw = reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(files)
        else:
            # positions are the file's own, so names are unique even where a header repeats one
            names = [n if header.index(n) == i else f"{n}_{i}" for i, n in enumerate(header)]
            raw = reader.schema(T.StructType([T.StructField(n, T.StringType(), True) for n in names])).csv(files)
        if row_id:
            raw = raw.withColumn(ROW_ID, any_row_id())
        parts.append(conform(raw, schema, keep=[ROW_ID] if row_id else ()))
    if row_id:
        # ids of different groups would meet; the group's number keeps them apart
        parts = [p.withColumn(ROW_ID, F.xxhash64(F.lit(i), ROW_ID)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)


ROW_ID = "measurement_row"


def any_row_id():
    """An id per scanned row for sources that number no rows themselves: it
    depends on the file split and the place in it, so retries give the same."""
    return F.monotonically_increasing_id()


def _with_row_id(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(ROW_ID, T.LongType(), True)])


def positional_name(i: int) -> str:
    return f"column{i:02d}"


def read_measurement_positional(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """A headerless measurement extract, columns taken by position; dates in any
    form that ``yyyymmdd`` knows."""
    fields = [T.StructField(positional_name(i), T.StringType(), True) for i in range(MEASUREMENT_WIDTH)]
    raw = spark.read.option("header", False).schema(T.StructType(fields)).csv(path)
    if row_id:
        raw = raw.withColumn(ROW_ID, any_row_id())
    named = raw.select(
        *[F.col(positional_name(MEASUREMENT_POSITIONS[f.name])).alias(f.name) for f in model.MEASUREMENT_SCHEMA.fields],
        *([ROW_ID] if row_id else []),
    )
    return conform(named, model.MEASUREMENT_SCHEMA, keep=[ROW_ID] if row_id else ())


def write_table_csv(df: DataFrame, path: str, upper_case_header: bool = True, compression: str | None = None) -> None:
    """Write a study table as CSV with a header (extract-style upper-case names)."""
    out = df.toDF(*[c.upper() for c in df.columns]) if upper_case_header else df
    w = out.write.mode("overwrite").option("header", True)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_measurement_positional(measurement: DataFrame, path: str) -> None:
    """Write measurements in the headerless positional layout."""
    slots = {v: k for k, v in MEASUREMENT_POSITIONS.items()}
    cols = []
    for i in range(MEASUREMENT_WIDTH):
        name = slots.get(i)
        if name is not None and name in measurement.columns:
            cols.append(F.col(name).cast("string").alias(positional_name(i)))
        else:
            cols.append(F.lit(None).cast("string").alias(positional_name(i)))
    measurement.select(*cols).write.mode("overwrite").option("header", False).csv(path)
