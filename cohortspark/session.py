"""Session construction and the shared scratch/checkpoint location."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for every study job. AQE re-plans joins from runtime
# sizes (broadcasting a side only once its real size is known) and splits
# skewed join partitions; the vectorised parquet reader and codegen are on by
# default and stay on.
STUDY_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when the split costs one more shuffle:
    # joins here are often followed by aggregates that reuse the join's
    # person_id partitioning, and without this AQE keeps a hot person whole
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortspark") -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("COHORTSPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in STUDY_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]):
    """Session settings for the jobs that run inside; afterwards the caller's are back."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Shuffle bytes and file bytes that a task of ``small_tasks`` reads. Rows of few
#: distinct columns take 20 to 50 times their compressed bytes in an aggregate's memory.
TASK_BYTES = "8m"


def small_tasks(spark: SparkSession, partitions: int):
    """Jobs that run inside shuffle into ``partitions`` at least, which are put
    together up to ``TASK_BYTES`` only, so that a task's memory does not grow with the
    input as long as ``partitions`` does."""
    least = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return settings(
        spark,
        {
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(least),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
            "spark.sql.files.maxPartitionBytes": TASK_BYTES,
        },
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder for written intermediate tables.

    Taken from the session's configuration only: ``spark.checkpoint.dir``,
    or, where that is unset, a folder under ``spark.sql.warehouse.dir``
    (which every executor shares as well). Never a machine-local temporary
    folder, which would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        current = sc.getCheckpointDir()
    return current


class Scratch:
    """Owner of written intermediate tables under the shared folder.

    Every copy belongs to one owner, and ``release`` deletes only that owner's
    copies: releasing one study cannot remove files that another one's lazy
    frames still read. Usable as a context manager.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        """A fresh, unique folder, remembered until ``release``."""
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def materialize(self, df, name: str):
        """Write ``df`` once as parquet and read it back.

        Used where an operator must pass over the same derived rows more than
        once: the expensive upstream (scans, joins) runs a single time, the
        written copy survives executor loss, and each later pass reads only the
        columns it needs.
        """
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def release(self) -> int:
        """Delete this owner's copies (through Hadoop's FileSystem, so on any
        shared store); returns how many there were. Call it once the frames that
        read them have been consumed."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        removed = 0
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                fs.delete(path, True)
                removed += 1
        return removed

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.release()


# Owner of the copies that registered queries make for the caller who asked for
# the query; that caller releases them.
_QUERIES: dict[str, Scratch] = {}


def query_scratch(spark: SparkSession) -> Scratch:
    return _QUERIES.setdefault(spark.sparkContext.applicationId, Scratch(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder owned by the session's registered queries."""
    return query_scratch(spark).path(name)


def release_scratch(spark: SparkSession) -> int:
    """Delete the copies that registered queries of this session made."""
    return query_scratch(spark).release()


def materialize(df, name: str):
    """A written copy owned by the session's registered queries."""
    return query_scratch(df.sparkSession).materialize(df, name)
