"""What the operators share: table reading, whole texts, free names, bucketed copies."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, settings


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_batches(spark: SparkSession, size: str):
    """Jobs that run inside give their Python workers Arrow batches of about ``size``
    at most, which bounds the buffers on both sides."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size})


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by ``key``: later joins
    and groups on it move only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
