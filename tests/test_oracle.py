"""Every registered query against its SQL oracle (DuckDB) at sf0.001."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from study_data import SF_SMALL

from cohortspark.plans.oracle import oracle_sql
from cohortspark.plans.registry import QUERIES

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) >= 62
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    problems, _ = compare(QUERIES[key](spark, SF_SMALL), con, ORACLE[key])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert df.columns[:3] == ["cohort", "n_measurements", "n_patients"]


GATE_SF = "/root/testdata/sf0.01"
GATE_KEYS = ["measurements_combined", "measurement_summary", "measurement_by_age_sex", "measurement_seq",
             "build_cohorts", "demographic_profile"]


@pytest.fixture(scope="module")
def gate_con():
    return duck(GATE_SF)


@pytest.mark.parametrize("key", GATE_KEYS)
def test_heavy_queries_match_oracle_at_gate_scale(spark, gate_con, key):
    problems, _ = compare(QUERIES[key](spark, GATE_SF), gate_con, ORACLE[key])
    assert not problems, problems
