"""Load the four study inputs from an extract folder (CSV or parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import csv as CSV
from .dimensions import concept_frame
from .fixtures import StudyTables, scan_row_id

TABLES = ["person", "condition_occurrence", "measurement"]


def _read(spark: SparkSession, path: str, table: str, fmt: str, infer_schema: bool) -> DataFrame:
    # measurements carry a per-row id from the scan, used to spread a hot person's rows
    row_id = table == "measurement"
    if fmt == "csv-positional" and row_id:
        return CSV.read_measurement_positional(spark, path, row_id=True)
    if fmt in ("csv", "csv-positional"):
        return CSV.read_table_csv(spark, path, table, infer_schema=infer_schema, row_id=row_id)
    raw = spark.read.format(fmt).load(path)
    if not row_id:
        return CSV.conform(raw, CSV.SCHEMAS[table])
    # parquet numbers its rows, which leaves filter pushdown alone
    raw = raw.withColumn(CSV.ROW_ID, scan_row_id() if fmt == "parquet" else CSV.any_row_id())
    return CSV.conform(raw, CSV.SCHEMAS[table], keep=[CSV.ROW_ID])


def load_extract(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    names: dict[str, str] | None = None,
    concept_path: str | None = None,
    infer_schema: bool = False,
) -> StudyTables:
    """Study tables from ``folder/<name>`` (a file, a glob or a directory).

    ``names`` maps table -> path under ``folder`` (default: the table name,
    e.g. ``person`` or ``person.csv.bz2``). Columns are matched by name,
    case-insensitively, and cast to the declared schemas; the concept
    dimension defaults to the built-in labels.
    """
    names = names or {}
    base = folder.rstrip("/")
    t = {name: _read(spark, f"{base}/{names.get(name, name)}", name, fmt, infer_schema) for name in TABLES}
    concept = (
        _read(spark, concept_path, "concept", fmt, infer_schema) if concept_path else concept_frame(spark)
    )
    return StudyTables(
        person=t["person"], condition=t["condition_occurrence"], measurement=t["measurement"], concept=concept
    )


__all__ = ["load_extract", "TABLES"]
