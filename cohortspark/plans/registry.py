"""Named study queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the supplied tables through the study fixtures (so its
work grows with them). Building a query is lazy but for the footers of the
tables it reads, with these exceptions, each of which writes a copy that is read
more than once: exact percentiles (the counted values, in slices: ``PERCENTILE``
below; those over all diseases write their result instead, after which the
slices are deleted), ``measurement_seq`` (the sorted slices), and the queries
that read back what they stored (``STORED``). Nothing is collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_yyyymmdd
from ..functions.numeric import round_cast_int, round_dp
from ..operators import checks as K
from ..operators import cohorts as C
from ..operators import demographics as D
from ..operators import diseases as M
from ..operators import outcomes as O
from ..operators import report as R
from ..operators import sampling as X
from ..operators import stats as S
from ..operators import stratify as T
from ..session import Scratch, materialize, query_scratch, scratch_path, small_tasks
from ..sources import csv as CSV
from ..sources import model
from ..sources.dimensions import catalogue_frame, concept_frame
from ..sources.fixtures import StudyTables, load_study, read_table
from ..sources.sinks import export_frame, json_records
from . import stored as ST
from .study import Study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Queries that write a copy while being built (see above).
PERCENTILE = {
    "measurement_summary", "measurement_summary_by_concept", "median_by_cohort", "quartiles_by_cohort",
    "measurement_by_age_sex", "age_bands_ordered", "box_plot", "summary_card", "summary_json",
    "summary_by_disease_and_concept", "age_sex_by_disease_and_concept",
}
STORED = {"scan_csv", "scan_csv_positional", "stored_summary", "stored_by_age_sex", "stored_demographics", "exported_pivot"}

# Measurement rows of a task of the queries over all diseases, at most about.
ROWS_PER_TASK = 250_000

# Disease used by the NOT IN exclusion query (any disease id works).
NOT_IN_DISEASE_ID = 320128


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def study(spark: SparkSession, sf_dir: str, **kw) -> Study:
    kw.setdefault("scratch", query_scratch(spark))
    return Study(load_study(spark, sf_dir), **kw)


# -- cohorts -----------------------------------------------------------------


@register("case_cohort")
def _case_cohort(spark, sf):
    return study(spark, sf).case


@register("control_cohort")
def _control_cohort(spark, sf):
    return study(spark, sf).control


@register("first_measurement")
def _first_measurement(spark, sf):
    return C.first_event(load_study(spark, sf).measurement)


@register("cohort_counts")
def _cohort_counts(spark, sf):
    s = study(spark, sf)
    return C.cohort_counts(s.case, s.control)


@register("build_cohorts")
def _build_cohorts(spark, sf):
    t = load_study(spark, sf)
    return C.build_cohorts(t.person, t.condition, model.DISEASE_IDS)


@register("cohort_union")
def _cohort_union(spark, sf):
    return study(spark, sf).cohorts


@register("non_case_persons")
def _non_case_persons(spark, sf):
    s = study(spark, sf)
    return C.non_case_persons(s.t.person.select("person_id"), s.case)


@register("control_index_dates")
def _control_index_dates(spark, sf):
    s = study(spark, sf)
    return C.control_index_dates(s.t.person, s.case, s.t.measurement)


@register("not_in_cohort")
def _not_in_cohort(spark, sf):
    t = load_study(spark, sf)
    return C.not_in_cohort(t.person, t.condition, NOT_IN_DISEASE_ID)


@register("distinct_case_persons")
def _distinct_case_persons(spark, sf):
    return C.distinct_case_persons(load_study(spark, sf).condition)


@register("control_sample")
def _control_sample(spark, sf):
    return X.sample_controls(study(spark, sf).control)


# -- demographics --------------------------------------------------------------


@register("demographics")
def _demographics(spark, sf):
    return study(spark, sf).demographics


@register("demographic_profile")
def _demographic_profile(spark, sf):
    return study(spark, sf).profile


@register("demographic_report")
def _demographic_report(spark, sf):
    return D.demographic_report(study(spark, sf).demographics)


@register("cohort_persons")
def _cohort_persons(spark, sf):
    s = study(spark, sf)
    return D.cohort_persons(s.cohorts, s.t.person)


@register("gender_labels")
def _gender_labels(spark, sf):
    t = load_study(spark, sf)
    return D.gender_labels(t.person, t.concept).select("person_id", "gender_concept_id", "gender")


@register("gender_counts")
def _gender_counts(spark, sf):
    return D.gender_counts(study(spark, sf).demographics)


@register("pct_male")
def _pct_male(spark, sf):
    return D.pct_male(study(spark, sf).demographics)


@register("profile_display")
def _profile_display(spark, sf):
    return D.profile_display(study(spark, sf).profile)


@register("age_at_index")
def _age_at_index(spark, sf):
    return study(spark, sf).ages


@register("age_bands")
def _age_bands(spark, sf):
    return D.age_bands(study(spark, sf).ages)


# -- outcomes and statistics ---------------------------------------------------


@register("measurements_combined")
def _measurements_combined(spark, sf):
    return study(spark, sf).measurements


@register("positive_measurements")
def _positive_measurements(spark, sf):
    return O.positive_measurements(load_study(spark, sf).measurement).drop("measurement_row")


@register("post_index_measurements")
def _post_index_measurements(spark, sf):
    s = study(spark, sf)
    return O.post_index_measurements(s.t.measurement, s.cohorts, s.salting_counts)


@register("days_from_index")
def _days_from_index(spark, sf):
    return study(spark, sf).measurements.select("cohort", "person_id", "measurement_date", "days_from_index")


@register("measurement_summary")
def _measurement_summary(spark, sf):
    return study(spark, sf).summary


@register("measurement_summary_by_concept")
def _measurement_summary_by_concept(spark, sf):
    return study(spark, sf).summary_by_concept


def _by_disease(spark, sf) -> tuple[StudyTables, DataFrame]:
    t = load_study(spark, sf)
    members = M.memberships(t.person, t.condition, t.measurement)
    return t, M.extract_measurements_by_disease(t.measurement, members)


def _in_small_tasks(spark, sf, stats: Callable[[Scratch], DataFrame], name: str) -> DataFrame:
    """The rows of ``stats(scratch)``, written; what the scratch holds is deleted. A
    measurement counts for every disease, so these aggregates hold several times the
    rows of the table: they run in tasks whose number follows the table (its row
    count is in the files' footers)."""
    rows = read_table(spark, sf, "lineitem").count()
    with small_tasks(spark, -(-rows // ROWS_PER_TASK)), Scratch(spark) as scratch:
        return materialize(stats(scratch), name)


@register("summary_by_disease_and_concept")
def _summary_by_disease_and_concept(spark, sf):
    """Box-plot statistics for every offered disease and analyte, in one job."""

    def stats(scratch):
        _, mc = _by_disease(spark, sf)
        return S.group_stats(mc, ["disease_concept_id", "cohort", "measurement_concept_id"], scratch=scratch)

    return _in_small_tasks(spark, sf, stats, "by_disease_and_concept")


@register("age_sex_by_disease_and_concept")
def _age_sex_by_disease_and_concept(spark, sf):
    def stats(scratch):
        t, mc = _by_disease(spark, sf)
        return T.measurement_by_age_sex(mc, t.person, t.concept, scratch=scratch, by=["disease_concept_id", "measurement_concept_id"])

    return _in_small_tasks(spark, sf, stats, "age_sex_by_disease_and_concept")


def _cohort_stats(spark, sf, stats):
    return S.group_stats(study(spark, sf).measurements, ["cohort"], stats=stats)


@register("mean_by_cohort")
def _mean_by_cohort(spark, sf):
    return _cohort_stats(spark, sf, ["mean_value"])


@register("median_by_cohort")
def _median_by_cohort(spark, sf):
    return _cohort_stats(spark, sf, ["median_value"])


@register("quartiles_by_cohort")
def _quartiles_by_cohort(spark, sf):
    return _cohort_stats(spark, sf, ["p25", "median_value", "p75"])


@register("range_by_cohort")
def _range_by_cohort(spark, sf):
    return _cohort_stats(spark, sf, ["min_value", "max_value"])


@register("stddev_by_cohort")
def _stddev_by_cohort(spark, sf):
    return _cohort_stats(spark, sf, ["std_dev"])


@register("rounded_stats")
def _rounded_stats(spark, sf):
    mc = study(spark, sf).measurements
    agg = mc.groupBy("cohort", "measurement_concept_id").agg(
        F.avg("value_numeric").alias("_mean"), F.stddev_samp("value_numeric").alias("_sd")
    )
    return agg.select(
        "cohort",
        "measurement_concept_id",
        round_dp(F.col("_mean"), 1).alias("mean_1dp"),
        round_dp(F.col("_mean"), 2).alias("mean_2dp"),
        round_dp(F.col("_sd"), 2).alias("std_dev_2dp"),
    )


@register("measurement_by_age_sex")
def _measurement_by_age_sex(spark, sf):
    return study(spark, sf).by_age_sex


@register("age_bands_ordered")
def _age_bands_ordered(spark, sf):
    return T.age_bands_ordered(study(spark, sf).by_age_sex)


@register("measurement_type_counts")
def _measurement_type_counts(spark, sf):
    s = study(spark, sf)
    return T.measurement_type_counts(s.measurements, s.catalogue)


@register("measurement_sample")
def _measurement_sample(spark, sf):
    return T.measurement_sample(study(spark, sf).measurements)


@register("measurement_seq")
def _measurement_seq(spark, sf):
    return X.row_ids(study(spark, sf).measurements, T.SAMPLE_ORDER, "measurement_id")


# -- selectors, catalogue, reports ---------------------------------------------


@register("disease_list")
def _disease_list(spark, sf):
    return study(spark, sf).disease_list()


@register("disease_options")
def _disease_options(spark, sf):
    return R.disease_options(study(spark, sf).disease_list())


@register("patients_per_concept")
def _patients_per_concept(spark, sf):
    return R.patients_per_concept(load_study(spark, sf).condition)


@register("measurement_catalogue")
def _measurement_catalogue(spark, sf):
    m = load_study(spark, sf).measurement
    seen = m.groupBy(F.col("measurement_concept_id").alias("concept_id")).agg(
        F.count(F.lit(1)).alias("n_measurements"), F.count_distinct("person_id").alias("n_patients")
    )
    # The catalogue is the preserved side; `seen` holds one row per analyte.
    return catalogue_frame(spark).join(seen, "concept_id", "left").select(
        "concept_id",
        "name",
        "unit",
        F.coalesce("n_measurements", F.lit(0)).cast("bigint").alias("n_measurements"),
        F.coalesce("n_patients", F.lit(0)).cast("bigint").alias("n_patients"),
    )


@register("concept_dim")
def _concept_dim(spark, sf):
    t = load_study(spark, sf)
    conditions = t.condition.groupBy(F.col("condition_concept_id").alias("concept_id")).agg(
        F.count(F.lit(1)).alias("n_condition_rows")
    )
    genders = t.person.groupBy(F.col("gender_concept_id").alias("concept_id")).agg(
        F.count(F.lit(1)).alias("n_gender_persons")
    )
    return (
        concept_frame(spark)
        .join(conditions, "concept_id", "left")
        .join(genders, "concept_id", "left")
        .select(
            "concept_id",
            "concept_name",
            F.coalesce("n_condition_rows", F.lit(0)).cast("bigint").alias("n_condition_rows"),
            F.coalesce("n_gender_persons", F.lit(0)).cast("bigint").alias("n_gender_persons"),
        )
    )


@register("age_sex_pivot")
def _age_sex_pivot(spark, sf):
    return study(spark, sf).age_sex_pivot()


@register("box_plot")
def _box_plot(spark, sf):
    return study(spark, sf).box_plot()


@register("summary_card")
def _summary_card(spark, sf):
    return study(spark, sf).summary_card()


@register("summary_json")
def _summary_json(spark, sf):
    renames = {"mean_value": "mean", "median_value": "median", "min_value": "min", "max_value": "max"}
    return json_records(study(spark, sf).summary.orderBy("cohort"), renames, keep=["cohort"])


@register("load_checks")
def _load_checks(spark, sf):
    s = study(spark, sf)
    n = F.count(F.lit(1))
    finished = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    expected = {
        "person_rows": read_table(spark, sf, "customer").agg(n),
        "condition_rows": read_table(spark, sf, "orders").agg(n),
        "measurement_rows": read_table(spark, sf, "lineitem").select("l_orderkey").join(finished, "l_orderkey").agg(n),
    }
    return K.load_checks(s.t.person, s.t.condition, s.t.measurement, s.case, s.control, expected)


@register("cohort_cards")
def _cohort_cards(spark, sf):
    s = study(spark, sf)
    return R.cohort_cards(C.cohort_counts(s.case, s.control), s.t.concept, s.disease_id)


# -- stored tables, views, exports ----------------------------------------------


def _stored(spark, sf) -> str:
    """Builds the derived tables under a prefix of their own; returns it."""
    prefix = f"q{uuid.uuid4().hex[:12]}_"
    s = study(spark, sf, scratch=query_scratch(spark))
    s.build_tables(prefix=prefix, folder=scratch_path(spark, "tables"))
    return prefix


@register("stored_summary")
def _stored_summary(spark, sf):
    return ST.stored_summary(spark, _stored(spark, sf))


@register("stored_by_age_sex")
def _stored_by_age_sex(spark, sf):
    return ST.stored_by_age_sex(spark, _stored(spark, sf))


@register("stored_demographics")
def _stored_demographics(spark, sf):
    return ST.stored_demographics(spark, _stored(spark, sf))


@register("view_case_patients")
def _view_case_patients(spark, sf):
    """Patients of one disease, by SQL with a bound parameter over the views."""
    prefix = f"q{uuid.uuid4().hex[:12]}_"
    study(spark, sf).register_views(prefix=prefix, reports=False)
    text = f"""SELECT co.person_id, p.year_of_birth, COUNT(*) AS n_records
               FROM {prefix}condition_occurrence co JOIN {prefix}person p ON p.person_id = co.person_id
               WHERE co.condition_concept_id = :disease GROUP BY co.person_id, p.year_of_birth"""
    return spark.sql(text, args={"disease": model.DEFAULT_DISEASE_ID})


@register("exported_pivot")
def _exported_pivot(spark, sf):
    """The age band x sex pivot written as CSV for charting tools, read back."""
    path = scratch_path(spark, "pivot_csv")
    pivot = study(spark, sf).age_sex_pivot()
    export_frame(pivot, path, "csv")
    return spark.read.schema(pivot.schema).option("header", True).csv(path)


# -- sources ------------------------------------------------------------------


@register("scan_csv")
def _scan_csv(spark, sf):
    """Measurements written as an extract-style CSV (upper-case header,
    bzip2) to the shared scratch folder, then read back by header name: a round
    trip, whose time is that of writing bzip2."""
    path = scratch_path(spark, "measurement_csv")
    CSV.write_table_csv(load_study(spark, sf).measurement, path, compression="bzip2")
    return CSV.read_table_csv(spark, path, "measurement")


@register("scan_csv_positional")
def _scan_csv_positional(spark, sf):
    path = scratch_path(spark, "measurement_positional")
    CSV.write_measurement_positional(load_study(spark, sf).measurement, path)
    return CSV.read_measurement_positional(spark, path)


@register("parse_dates")
def _parse_dates(spark, sf):
    c = load_study(spark, sf).condition
    return c.select(
        "person_id",
        "condition_concept_id",
        "condition_start_date",
        parse_yyyymmdd(F.col("condition_start_date")).alias("start_date"),
    )


@register("round_cast")
def _round_cast(spark, sf):
    m = O.positive_measurements(load_study(spark, sf).measurement)
    half = F.col("value_numeric") / 2
    return m.select(
        "person_id",
        "measurement_concept_id",
        "value_numeric",
        half.alias("value_half"),
        round_cast_int(half).alias("value_half_int"),
    )


# -- keyed draws and clamping ----------------------------------------------------


@register("keyed_uniform")
def _keyed_uniform(spark, sf):
    return X.person_uniform(load_study(spark, sf).person, salt="person")


@register("clamped_values")
def _clamped_values(spark, sf):
    return study(spark, sf).clamped().select(
        "cohort",
        "person_id",
        "measurement_date",
        "measurement_concept_id",
        "value_numeric",
        "clamp_low",
        "clamp_high",
        "value_clamped",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline report: box-plot statistics per cohort."""
    return QUERIES["measurement_summary"](spark, sf_dir)
