import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from study_data import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cohortspark.session import STUDY_CONF

    b = (
        SparkSession.builder.master("local[*]")
        .appName("cohortspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="cohortspark-test-wh-"))
    )
    for k, v in STUDY_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # the shared checkpoint folder comes from the session's configuration;
    # only when none is configured do tests use a private one
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortspark-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from cohortspark.sources.fixtures import load_study

    return load_study(spark, SF_SMALL)
