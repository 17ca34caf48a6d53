"""Training-corpus pipeline: quality, near-duplicates, benchmarks, secrets, pieces.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns documents (the last one: their piece ids). Between stages the documents
are written as Parquet to the shared folder and read again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import decontaminate, quality_classifier, secret_scan, sentencepiece_lattice, simhash_dedup
from cohortspark.llm.common import read, whole_text
from cohortspark.session import materialize

#: Characters of a bundle of the last stage: half of the operator's own bundles, as the
#: executors' Python workers have run four other stages before.
BUNDLE = 7_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes."""
    model, _ = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(model.score(model.raw(whole_text())) >= quality_classifier.PASS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of 3 words, 2 bits."""
    return simhash_dedup.one_of_each(docs, 3, 2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced."""
    return secret_scan.redact(docs, secret_scan.OWNER, secret_scan.REPOSITORY)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_sha256, round_trip, ids): the piece ids of
    every document, and whether they decode to its text."""
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.default_model(), BUNDLE)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", pieces),
]

#: No stage but the reading can be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
