"""Skew-safe distributed operators against brute force.

A third of all rows sits in one group (or is one repeated row), and the
results must not depend on the number of slices/partitions.
"""

import random

import numpy as np
import pytest

from cohortspark.operators.sampling import row_ids
from cohortspark.operators.stats import exact_percentiles, group_stats


def skewed_rows(n=3000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            g = "hot"
        else:
            g = f"g{rng.randrange(5)}"
        v = None if rng.random() < 0.05 else round(rng.gauss(50, 20), rng.choice([0, 1, 3]))
        rows.append((g, i % 97, v))
    rows += [("one", 1, 4.25)]
    return rows


def brute_percentile(values, p):
    vs = sorted(v for v in values if v is not None)
    return float(np.percentile(vs, p * 100, method="linear")) if vs else None


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_exact_percentiles_match_brute_force(spark, slices):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, person_id long, v double")
    pct = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
    got = {
        r.g: r
        for r in exact_percentiles(df, ["g"], "v", pct, num_slices=slices).collect()
    }
    groups = {}
    for g, _, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vals in groups.items():
        for name, p in pct.items():
            assert getattr(got[g], name) == pytest.approx(brute_percentile(vals, p), rel=1e-12, abs=1e-12), (g, name)


def test_exact_percentiles_null_group_key_and_global(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in exact_percentiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 2.0}
    glob = exact_percentiles(df, [], "v", {"m": 0.5}).collect()
    assert glob[0].m == 2.0


def test_exact_percentiles_equal_the_built_in_bit_for_bit(spark):
    import struct

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(f"g{i % 40}", rng.uniform(-1, 1) * 10 ** rng.randrange(-5, 9)) for i in range(4000)]
    rows += [("inf", float("-inf")), ("inf", 5.0), ("both", float("-inf")), ("both", float("inf"))]
    rows += [("big", -1.7e308), ("big", 1.7e308), ("same", 0.1), ("same", 0.1), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    pct = {"p10": 0.1, "p25": 0.25, "m": 0.5, "p75": 0.75, "p99": 0.99}
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", pct, num_slices=7).collect()}
    want = df.where("v is not null").groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in pct.items()])
    bits = lambda x: struct.pack(">d", x)
    rows = want.collect()
    assert set(got) == {r.g for r in rows}
    for r in rows:
        for n in pct:
            assert bits(getattr(got[r.g], n)) == bits(getattr(r, n)), (r.g, n)


def test_group_stats_against_duckdb(spark):
    import duckdb

    rows = [(g, p, v) for g, p, v in skewed_rows()]
    df = spark.createDataFrame(rows, "cohort string, person_id long, value_numeric double")
    got = sorted(tuple(r) for r in group_stats(df, ["cohort"]).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE t(cohort VARCHAR, person_id BIGINT, value_numeric DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    from cohortspark.plans.oracle import BOX, box_sql

    want = sorted(tuple(r) for r in con.execute(box_sql(["cohort"], BOX, source="t")).fetchall())
    assert got == want


@pytest.mark.parametrize("slices,chunk", [(1, 1_000_000), (7, 1_000_000), (16, 50)])
def test_row_ids_dense_with_hot_copies(spark, slices, chunk):
    # one identical row makes up a third of the input
    rows = [("CASE", 1, 5.0)] * 400 + [("CASE", i % 13, float(i % 7)) for i in range(800)]
    df = spark.createDataFrame(rows, "cohort string, person_id long, v double")
    out = row_ids(df, ["cohort", "person_id", "v"], "rid", num_slices=slices, chunk_rows=chunk).collect()
    ids = sorted(r.rid for r in out)
    assert ids == list(range(1, len(rows) + 1))
    expected = sorted(rows)
    got = sorted(((r.cohort, r.person_id, r.v), r.rid) for r in out)
    # ids follow the order: the k-th smallest row holds id k (copies interchangeable)
    assert [g[0] for g in sorted(got, key=lambda x: x[1])] == expected


def test_approx_opt_in_close_to_exact(spark):
    rows = skewed_rows(4000, seed=11)
    df = spark.createDataFrame(rows, "cohort string, person_id long, value_numeric double")
    exact = {r.cohort: r for r in group_stats(df, ["cohort"]).collect()}
    approx = {r.cohort: r for r in group_stats(df, ["cohort"], approx=True).collect()}
    plan = group_stats(df, ["cohort"], approx=True)._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and "approx_count_distinct" in plan
    for g, e in exact.items():
        a = approx[g]
        assert a.n_measurements == e.n_measurements and a.mean_value == e.mean_value
        assert abs(a.n_patients - e.n_patients) <= max(2, 0.05 * e.n_patients)
        spread = (e.max_value - e.min_value) or 1.0
        for name in ("p25", "median_value", "p75"):
            assert abs(getattr(a, name) - getattr(e, name)) <= 0.05 * spread


def test_weighted_stats_equal_expanded_rows(spark):
    import random

    rng = random.Random(5)
    base = [(rng.choice("ab"), rng.randrange(30), float(rng.randrange(100)) / 4, rng.randrange(1, 6)) for _ in range(300)]
    base.append(("c", 1, 2.5, 1))  # a one-row group: NULL standard deviation
    weighted = spark.createDataFrame(base, "cohort string, person_id long, value_numeric double, w long")
    expanded = spark.createDataFrame(
        [(g, p, v) for g, p, v, w in base for _ in range(w)], "cohort string, person_id long, value_numeric double"
    )
    a = sorted(tuple(r) for r in group_stats(weighted, ["cohort"], weight_col="w").collect())
    b = sorted(tuple(r) for r in group_stats(expanded, ["cohort"]).collect())
    assert a == b


def test_global_stats_without_groups_match_duckdb(spark):
    import duckdb

    from cohortspark.plans.oracle import BOX, r

    rows = [(p, v) for _, p, v in skewed_rows(2000, seed=3)]
    df = spark.createDataFrame(rows, "person_id long, value_numeric double")
    out = group_stats(df, [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = tuple(out.collect()[0])
    con = duckdb.connect()
    con.execute("CREATE TABLE t(person_id BIGINT, value_numeric DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute(
        f"""SELECT COUNT(*), COUNT(DISTINCT person_id), {r('AVG(value_numeric)', 2)},
            {r('MEDIAN(value_numeric)', 2)},
            {r('PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY value_numeric)', 2)},
            {r('PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY value_numeric)', 2)},
            {r('MIN(value_numeric)', 2)}, {r('MAX(value_numeric)', 2)}, {r('STDDEV(value_numeric)', 2)} FROM t"""
    ).fetchone()
    assert len(BOX) == len(got) and got == tuple(want)


def test_global_weighted_stats_equal_expanded(spark):
    base = [(i % 7, float(i % 11) / 2, 1 + i % 3) for i in range(200)]
    weighted = spark.createDataFrame(base, "person_id long, value_numeric double, w long")
    expanded = spark.createDataFrame([(p, v) for p, v, w in base for _ in range(w)], "person_id long, value_numeric double")
    a = group_stats(weighted, [], weight_col="w")
    assert "CartesianProduct" not in a._jdf.queryExecution().executedPlan().toString()
    assert tuple(a.collect()[0]) == tuple(group_stats(expanded, []).collect()[0])


def test_global_stats_of_no_rows(spark):
    none = spark.createDataFrame([], "person_id long, value_numeric double")
    got = group_stats(none, []).collect()
    assert len(got) == 1 and got[0].n_measurements == 0 and got[0].n_patients == 0 and got[0].median_value is None


def test_outcomes_by_disease_match_one_study_each(spark):
    from cohortspark.plans.registry import QUERIES, study
    from study_data import SF_SMALL

    many = QUERIES["summary_by_disease_and_concept"](spark, SF_SMALL).collect()
    strata = QUERIES["age_sex_by_disease_and_concept"](spark, SF_SMALL).collect()
    assert len({r.disease_concept_id for r in many}) == 4
    for disease in (201826, 320128):
        one = study(spark, SF_SMALL, disease_id=disease)
        assert sorted(tuple(r)[1:] for r in many if r.disease_concept_id == disease) == sorted(map(tuple, one.summary_by_concept.collect()))
    analyte = study(spark, SF_SMALL, disease_id=320128, measurement_concept_id=3004501)
    own = [tuple(r)[2:] for r in strata if (r.disease_concept_id, r.measurement_concept_id) == (320128, 3004501)]
    assert sorted(own, key=str) == sorted(map(tuple, analyte.by_age_sex.collect()), key=str)


@pytest.mark.parametrize("key", ["summary_by_disease_and_concept", "age_sex_by_disease_and_concept"])
def test_tasks_over_all_diseases_follow_the_rows(spark, monkeypatch, key):
    """Aggregates run in a number of tasks that grows with the measurements, not in
    the session's fixed one; the session's settings stay."""
    from cohortspark.plans import registry
    from cohortspark.session import Scratch
    from study_data import SF_SMALL

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    usual = sorted(map(str, registry.QUERIES[key](spark, SF_SMALL).collect()))
    seen, write = [], Scratch.materialize
    monkeypatch.setattr(registry, "ROWS_PER_TASK", rows // 20)
    monkeypatch.setattr(Scratch, "materialize", lambda self, df, n: (seen.append(spark.conf.get(name)), write(self, df, n))[1])
    assert sorted(map(str, registry.QUERIES[key](spark, SF_SMALL).collect())) == usual
    assert len(seen) == 2 and min(map(int, seen)) >= 20
    assert spark.conf.get(name, None) is None
