"""Batch build of a study: extracts -> cohorts -> demographics -> outcomes
-> summaries, stored as tables (the idempotent full rebuild).

    python -m cohortspark.plans.build --source DIR [--format csv|parquet]
        [--disease 201826] [--measurement 3004501] [--prefix study_]
        [--buckets N] [--export DIR]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import report as R
from ..operators import stats as S
from ..session import Scratch
from ..sources.extract import load_extract
from ..sources.sinks import export_frame
from .study import Study


def build(
    spark: SparkSession,
    source: str,
    fmt: str = "csv",
    disease_id: int = 201826,
    measurement_concept_id: int | None = None,
    prefix: str = "",
    buckets: int | None = None,
    export: str | None = None,
) -> dict[str, str]:
    """Build every derived table; optionally export the chart frames, which are
    read from the stored tables."""
    tables = load_extract(spark, source, fmt)
    with Scratch(spark) as scratch:
        study = Study.prepared(tables, disease_id=disease_id, measurement_concept_id=measurement_concept_id, scratch=scratch)
        built = study.build_tables(prefix=prefix, buckets=buckets)
        if export:
            base = export.rstrip("/")
            mc = spark.table(built["measurements_combined"])
            summary = spark.table(built["measurement_summary"])
            by_concept = S.group_stats(mc, ["cohort", "measurement_concept_id"], scratch=scratch)
            export_frame(R.box_plot(summary, tables.concept, disease_id), f"{base}/box_plot", "json")
            export_frame(R.age_sex_pivot(mc, tables.person, tables.concept), f"{base}/age_sex_pivot", "csv")
            export_frame(R.summary_card(by_concept, study.catalogue), f"{base}/summary_card", "json")
    return built


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--source", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "csv-positional", "parquet", "orc", "json"])
    p.add_argument("--disease", type=int, default=201826)
    p.add_argument("--measurement", type=int, default=None)
    p.add_argument("--prefix", default="")
    p.add_argument("--buckets", type=int, default=None)
    p.add_argument("--export", default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cohortspark-build").getOrCreate()
    for name, table in build(spark, a.source, a.format, a.disease, a.measurement, a.prefix, a.buckets,
                             a.export).items():
        print(f"{name}\t{table}")


if __name__ == "__main__":
    main()
