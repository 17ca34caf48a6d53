"""Session helpers: shared folder, materialisation, scratch release."""

import os

import pytest
from cohortspark.session import Scratch, checkpoint_dir, materialize, release_scratch, scratch_path, settings, small_tasks


def test_checkpoint_dir_from_session(spark):
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_owners_release_only_their_own_copies(spark):
    a = Scratch(spark)
    with Scratch(spark) as b:
        kept, gone = a.materialize(spark.range(3), "a"), b.materialize(spark.range(4), "b")
        assert gone.count() == 4
    assert kept.count() == 3
    assert not os.path.exists(os.path.dirname(gone.inputFiles()[0].replace("file:", "")))
    assert a.release() == 1 and a.release() == 0


def test_materialize_then_release(spark):
    release_scratch(spark)  # start from a clean list
    df = materialize(spark.range(10).toDF("x"), "unit")
    assert df.count() == 10
    path = scratch_path(spark, "unused")  # never written: release skips it
    removed = release_scratch(spark)
    assert removed == 1
    local = df.inputFiles()[0].replace("file:", "")
    assert not os.path.exists(os.path.dirname(local))
    assert not os.path.exists(path.replace("file:", ""))


def test_settings_are_put_back(spark):
    own, unset = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(own)
    with pytest.raises(ZeroDivisionError), settings(spark, {own: "77", unset: "99"}):
        assert (spark.conf.get(own), spark.conf.get(unset)) == ("77", "99")
        1 / 0
    assert (spark.conf.get(own), spark.conf.get(unset, None)) == (before, None)


def test_small_tasks_are_as_many_as_asked_or_as_the_session_has(spark):
    count = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for asked in (1, usual + 40):
        with small_tasks(spark, asked):
            assert int(spark.conf.get(count)) == max(asked, usual)
    assert spark.conf.get(count, None) is None
