"""Recall against brute force, exact scores and order, hot buckets."""

import random

import numpy as np
from cohortspark.llm import ann_search as A
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k):
    """query -> [(score, -id)] best first, by the definition."""
    ids = sorted({i for i, _ in rows})
    out = {}
    for q in (i for i in ids if i % 50 == 0):
        best = {}
        for a in (np.array(v, np.float64) for i, v in rows if i == q):
            for i, v in rows:
                b = np.array(v, np.float64)
                if i != q and len(a) == len(b):
                    score = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                    best[i] = max(score, best.get(i, -2))
        out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def search(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, VECTORS).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), *[F.lit(1).alias(c) for c in ("bucket", "score", "rank", "turn")]
    )
    got = {}
    for r in A.neighbours(df, F.col("id") % 50 == 0, k, **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_and_exact_scores(spark):
    from cohortspark.llm.common import read

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf, "embeddings").collect()]
    want = brute(rows, 5)
    got = {}
    for r in A.op2_ann_search(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, i, s in found:
            a, b = vectors[q], vectors[i]
            assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_awkward_vectors_ties_and_hot_buckets(spark, monkeypatch):
    """All axes probed: the result is the exact one. Small blocks cut the hot
    bucket of equal vectors into many."""
    monkeypatch.setattr(A, "BLOCK", 7)
    monkeypatch.setattr(A, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    hot = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, hot) for i in range(150, 220)] + [(300, [2 * x for x in hot]), (350, hot), (350, hot)]
    rows += [(400, [1.0, 0.0]), (401, [3.0, 0.0]), (450, [5.0]), (7, rows[3][1]), (7, rows[3][1])]
    useless = [(500, None), (550, []), (600, [0.0] * 6), (601, [float("nan")] * 6), (602, [float("inf"), *hot[1:]]), (603, [None, *hot[1:]]), (None, hot)]
    got = search(spark, rows + useless, tables=1, probes=99)
    want = brute(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items() if v}
    assert [i for i, _ in got[300]] == [150, 151, 152, 153, 154]
    assert [i for i, _ in got[400]] == [401] and 450 not in got


def test_queries_that_meet_too_few_get_all_candidates(spark):
    """Few probes and few vectors, opposite ones among them: nothing is left out."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in (0, 1, 2, 3)] + [(50, [1.0] * 16), (51, [-1.0] * 16)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(100, 140)]
    got = search(spark, rows, tables=2, probes=3)
    want = brute(rows, 5)
    assert set(got) == {q for q, v in want.items() if v}
    assert {i for i, _ in got[0]} == {1, 2, 3} and [i for i, _ in got[50]] == [51] and got[50][0][1] == -1
    assert all(len(v) == len(want[q]) for q, v in got.items())


def test_few_or_no_vectors(spark):
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    assert search(spark, [(0, [1.0, 2.0]), (3, [1.0, 2.0])]) == {0: [(3, 1.0)]} or search(spark, [(0, [1.0, 2.0]), (3, [1.0, 2.0])])[0][0][0] == 3
    empty = spark.createDataFrame([], VECTORS).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    assert A.neighbours(empty, F.col("id") % 50 == 0).collect() == []


def test_rotation_keeps_lengths_and_spreads_axes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 50))
    y = A.rotate(x, 1)
    assert y.shape == (200, 64) and np.allclose((x**2).sum(1), (y**2).sum(1))
    first = A.nearest_axes(x, 1, 3)
    assert first.shape == (200, 3) and len(np.unique(first[:, 0])) > 60
    assert (A.nearest_axes(-x, 1, 1)[:, 0] == (first[:, 0] + 64) % 128).all()
