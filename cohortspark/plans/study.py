"""One case/control study as a set of lazy DataFrames.

``Study`` wires the operators together for one disease (and optionally one
analyte). Each derived frame is built once per ``Study`` and reused, so a
report that needs several of them is still one plan. Frames are only evaluated
by the caller's action, with one exception that the method names say: exact
percentiles read a copy that is written when ``summary``, ``summary_by_concept``,
``by_age_sex`` (or a report of them) is first asked for. ``release`` deletes
these copies.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import demographics as D
from ..operators import outcomes as O
from ..operators import report as R
from ..operators import sampling as X
from ..operators import stats as S
from ..operators import stratify as T
from ..sources import model
from ..sources.dimensions import catalogue_frame, clamp_bounds_frame
from ..session import Scratch
from ..sources.fixtures import StudyTables


class Study:
    def __init__(
        self,
        tables: StudyTables,
        disease_id: int = model.DEFAULT_DISEASE_ID,
        measurement_concept_id: int | None = None,
        default_index_date: dt.date | None = model.DEFAULT_INDEX_DATE,
        activity: DataFrame | None = None,
        scratch: Scratch | None = None,
    ):
        """``activity`` (``cohorts.measurement_activity``, for instance a stored
        copy) gives first measurement dates and rows per person to the control
        index and to the outcome join's salting; without it each aggregates what
        it needs. ``scratch`` owns the written copies (default: a new one)."""
        self.t = tables
        self.spark = tables.person.sparkSession
        self.disease_id = int(disease_id)
        self.measurement_concept_id = measurement_concept_id
        self.default_index_date = default_index_date
        self.activity = activity
        self.scratch = scratch or Scratch(self.spark)

    @classmethod
    def prepared(cls, tables: StudyTables, *args, **kw) -> Study:
        """A study whose per-person measurement aggregate is written first, so that
        the measurement table is aggregated once for both of its uses."""
        study = cls(tables, *args, **kw)
        study.activity = study.scratch.materialize(C.measurement_activity(tables.measurement), "person_activity")
        return study

    def release(self) -> int:
        """Delete the copies this study wrote."""
        return self.scratch.release()

    # -- cohorts ---------------------------------------------------------
    @cached_property
    def case(self) -> DataFrame:
        return C.case_cohort(self.t.condition, self.disease_id)

    @cached_property
    def control(self) -> DataFrame:
        return C.control_cohort(
            self.t.person, self.case, self.t.measurement, self.default_index_date, activity=self.activity
        )

    @cached_property
    def cohorts(self) -> DataFrame:
        return C.cohort_union(self.case, self.control)

    # -- demographics ------------------------------------------------------
    @cached_property
    def demographics(self) -> DataFrame:
        return D.demographics(self.cohorts, self.t.person, self.t.concept)

    @cached_property
    def ages(self) -> DataFrame:
        return D.ages(self.cohorts, self.t.person)

    @cached_property
    def profile(self) -> DataFrame:
        return D.demographic_profile(self.demographics)

    # -- outcomes ----------------------------------------------------------
    @cached_property
    def analyte_measurements(self) -> DataFrame:
        """The measurement input, restricted to the chosen analyte if any."""
        m = self.t.measurement
        if self.measurement_concept_id is not None:
            m = m.where(F.col("measurement_concept_id") == int(self.measurement_concept_id))
        return m

    @property
    def salting_counts(self) -> DataFrame | None:
        """Rows per person for the outcome join's salting (all rows: an upper
        bound), from the shared aggregate if there is one."""
        return self.activity.select("person_id", "n_rows") if self.activity is not None else None

    @cached_property
    def measurements(self) -> DataFrame:
        return O.extract_measurements(self.analyte_measurements, self.cohorts, self.salting_counts)

    @cached_property
    def summary(self) -> DataFrame:
        return S.group_stats(self.measurements, ["cohort"], scratch=self.scratch)

    @cached_property
    def summary_by_concept(self) -> DataFrame:
        return S.group_stats(self.measurements, ["cohort", "measurement_concept_id"], scratch=self.scratch)

    @cached_property
    def by_age_sex(self) -> DataFrame:
        return T.measurement_by_age_sex(self.measurements, self.t.person, self.t.concept, scratch=self.scratch)

    # -- reports -----------------------------------------------------------
    @cached_property
    def catalogue(self) -> DataFrame:
        return catalogue_frame(self.spark)

    def disease_list(self, ids=model.DISEASE_IDS) -> DataFrame:
        return R.disease_list(self.t.condition, self.t.concept, ids)

    def box_plot(self) -> DataFrame:
        return R.box_plot(self.summary, self.t.concept, self.disease_id)

    def summary_card(self) -> DataFrame:
        return R.summary_card(self.summary_by_concept, self.catalogue)

    def age_sex_pivot(self) -> DataFrame:
        return R.age_sex_pivot(self.measurements, self.t.person, self.t.concept)

    def clamped(self) -> DataFrame:
        return X.clamp_by_category(self.measurements, clamp_bounds_frame(self.spark))

    # -- SQL surface and the derived-table build ---------------------------
    def frames(self) -> dict[str, DataFrame]:
        """The study's inputs and row-level derived tables under their table
        names, all lazy."""
        demog = self.demographics
        mc = self.measurements
        return {
            "person": self.t.person,
            "condition_occurrence": self.t.condition,
            "measurement": self.t.measurement,
            "concept": self.t.concept,
            "cohort_case": self.case,
            "cohort_control": self.control,
            "demographics_case": demog.where(F.col("cohort") == model.CASE).drop("cohort"),
            "demographics_control": demog.where(F.col("cohort") == model.CONTROL).drop("cohort"),
            "measurements_case": mc.where(F.col("cohort") == model.CASE),
            "measurements_control": mc.where(F.col("cohort") == model.CONTROL),
            "measurements_combined": mc,
        }

    def reports(self) -> dict[str, DataFrame]:
        """The statistics tables; asking for them writes the copies they read."""
        return {"measurement_summary": self.summary, "measurement_by_age_sex": self.by_age_sex}

    def register_views(self, prefix: str = "", reports: bool = True) -> list[str]:
        """Register the study's frames as session temp views, so the study can
        also be queried with SQL (``spark.sql(text, args=...)``). Without
        ``reports`` nothing is executed."""
        names = []
        for name, df in (self.frames() | (self.reports() if reports else {})).items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def build_tables(self, prefix: str = "", buckets: int | None = None, folder: str | None = None) -> dict[str, str]:
        """Create-or-replace the derived tables, in dependency order.

        Cohorts, demographics and the outcome table are stored first; what
        depends on one is built from its stored form, so the outcome join runs
        once, and the reports read its stored rows.

        The one-row-per-person tables (cohorts, demographics) are bucketed by
        ``person_id`` with one bucket count, so joins among them read
        co-located buckets instead of shuffling; a person cannot be hot in
        them. The measurement table is stored unbucketed: one person may
        own a large share of its rows, and a join that shuffles it keeps
        AQE's skew-join splitting, which a bucketed scan would give up. The
        aggregated reports are small and stored plain. ``folder`` (optional)
        holds the tables' files instead of the warehouse.
        """
        from ..sources.sinks import save_table

        built = {}

        def store(name: str, df: DataFrame, bucketed: bool = False) -> DataFrame:
            path = f"{folder.rstrip('/')}/{prefix}{name}" if folder else None
            save_table(df, prefix + name, bucket_by="person_id" if bucketed else None, buckets=buckets, path=path)
            built[name] = prefix + name
            return self.spark.table(prefix + name)

        case = store("cohort_case", self.case, bucketed=True)
        control = store("cohort_control", self.control, bucketed=True)
        cohorts = C.cohort_union(case, control)
        demog = D.demographics(cohorts, self.t.person, self.t.concept)
        for name, tag in (("demographics_case", model.CASE), ("demographics_control", model.CONTROL)):
            store(name, demog.where(F.col("cohort") == tag).drop("cohort"), bucketed=True)
        mc = store("measurements_combined", O.extract_measurements(self.analyte_measurements, cohorts, self.salting_counts))
        store("measurement_summary", S.group_stats(mc, ["cohort"], scratch=self.scratch))
        store("measurement_by_age_sex", T.measurement_by_age_sex(mc, self.t.person, self.t.concept, scratch=self.scratch))
        return built
