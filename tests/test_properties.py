"""Property tests: distributed operators equal their brute-force definition."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortspark.operators.sampling import row_ids
from cohortspark.operators.stats import exact_percentiles

ROWS = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c"]),
        st.one_of(st.none(), st.integers(-50, 50).map(lambda x: x / 4.0)),
    ),
    min_size=1,
    max_size=120,
)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=ROWS, p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), slices=st.integers(1, 9))
def test_percentile_property(spark, rows, p, slices):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in exact_percentiles(df, ["g"], "v", {"q": p}, num_slices=slices).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = float(np.percentile(sorted(vs), p * 100, method="linear"))
        assert abs(got[g] - want) <= 1e-9 * max(1.0, abs(want))


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=150),
       slices=st.integers(1, 7), chunk=st.sampled_from([2, 5, 1_000_000]))
def test_row_ids_property(spark, rows, slices, chunk):
    df = spark.createDataFrame(rows, "a int, b int")
    out = row_ids(df, ["b", "a"], "rid", num_slices=slices, chunk_rows=chunk).collect()
    assert sorted(r.rid for r in out) == list(range(1, len(rows) + 1))
    by_id = [(r.b, r.a) for r in sorted(out, key=lambda r: r.rid)]
    assert by_id == sorted((b, a) for a, b in rows)


@SETTINGS
@given(big=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=120),
       per_salt=st.integers(1, 40), with_ids=st.booleans())
def test_salted_join_equals_plain_join(spark, big, per_salt, with_ids):
    from pyspark.sql import functions as F

    from cohortspark.operators.joins import salted_join

    b = spark.createDataFrame(big, "person_id long, v int")
    if with_ids:
        b = b.withColumn("measurement_row", F.monotonically_increasing_id())
    small = spark.createDataFrame([(k, f"c{k}") for k in range(0, 5)], "person_id long, cohort string")
    counts = b.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_rows"))
    got = sorted((r.person_id, r.v, r.cohort) for r in salted_join(b, small, "person_id", counts, per_salt).collect())
    want = sorted((r.person_id, r.v, r.cohort) for r in b.join(small, "person_id").collect())
    assert got == want
