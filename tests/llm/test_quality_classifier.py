"""Held-out accuracy, the threshold and the awkward cases."""

import zlib

import numpy as np
from cohortspark.llm import quality_classifier as Q
from cohortspark.llm.common import read
from helpers import awkward, frame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_columns(spark):
    rows = {r.doc_id: r for r in Q.op10_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    held = [d for d in labels if rows[d].held_out]
    assert len(held) > 40 and np.mean([rows[d].predicted == labels[d] for d in held]) >= 0.95
    good, bad = ([rows[d].score for d in held if labels[d] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_learns_only_from_rows_that_are_not_held_out(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out = Q.remainder(F.col("doc_id")) == 2
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels)[0], Q.fit(docs, turned)[0]
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_preference_order_on_separable_rows():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, Q.N_FEATURES))
    x[:, 3] += 3 * y
    m = Q.bradley_terry(x, y)
    raw = ((x - m.mean) / m.scale) @ m.weights
    assert np.mean(raw[y == 1][:, None] > raw[y == 0][None, :]) > 0.97
    # with the classes' roles turned, the order turns
    assert np.mean(((x - m.mean) / m.scale @ Q.bradley_terry(x, 1 - y).weights)[y == 1].mean() < 0)


def test_awkward_rows_and_labels(spark):
    docs = frame(spark, awkward(), extra=True)
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (4, 0), (None, 0), (6, 1), (6, 1), (100, 1), (101, 5), (102, None), (8, 0)], "doc_id long, quality int"
    ).select("*", F.lit(1).alias("score"), F.lit("x").alias("text"))
    known = {r.doc_id: r.quality for r in Q.training_labels(labels).collect()}
    assert known == {d: q for d, q in ((4, 0), (6, 1), (100, 1), (8, 0)) if zlib.crc32(str(d).encode()) % 4 != 2}
    model, scored = Q.fit(docs, labels)
    assert scored.count() == docs.count() and scored.where("raw is null or isnan(raw)").count() == 0


def test_one_class_or_no_labels_keep_everything(spark):
    docs = frame(spark, awkward())
    for rows in ([], [(100, 1), (103, 1)]):
        model, scored = Q.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert scored.where(model.score(F.col("raw")) < Q.PASS).count() == 0


def test_empty_documents(spark):
    model, scored = Q.fit(frame(spark, awkward()).limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert scored.count() == 0


def test_threshold_scores_at_least_the_pass_mark(spark):
    m = Q.Model(np.zeros(1), np.ones(1), np.ones(1), 3.25)
    got = spark.createDataFrame([(3.25,), (3.2499999,), (50.0,), (-900.0,)], "raw double").select(m.score(F.col("raw")).alias("s")).collect()
    assert got[0].s >= 0.7 > got[1].s and got[2].s > 0.99 and 0 <= got[3].s < 0.01
