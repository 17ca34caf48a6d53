"""Sinks: derived tables, JSON records, chart exports; a table guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTableError(LookupError):
    """A derived table a report needs has not been built yet."""


def require_table(spark: SparkSession, name: str, hint: str = "") -> None:
    """Fail clearly when a derived table is missing."""
    if not spark.catalog.tableExists(name):
        msg = f"table '{name}' not found"
        raise MissingTableError(f"{msg}; {hint}" if hint else msg)


def save_table(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None, path: str | None = None
) -> None:
    """Create-or-replace a derived table, in the warehouse or under ``path``.

    With ``bucket_by='person_id'`` (same bucket count for every person-keyed
    table) later person joins read co-partitioned buckets without a shuffle.
    """
    if bucket_by:
        n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # one writer per bucket, so each bucket is one file rather than one per task
        w = df.repartition(n, bucket_by).write.bucketBy(n, bucket_by).sortBy(bucket_by)
    else:
        w = df.write
    w = w.mode("overwrite").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(name)


def json_records(df: DataFrame, renames: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as a JSON object string (columns renamed for the consumer).

    NULL fields are written as ``null`` rather than dropped, so every record
    has the same keys.
    """
    renames = dict(renames or {})
    fields = [F.col(c).alias(renames.get(c, c)) for c in df.columns]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*[F.col(k) for k in keep], record.alias("record"))


def export_frame(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a report frame for charting tools (parquet, csv or json)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
