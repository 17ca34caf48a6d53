"""One registered query per operator, applied to its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import oracle
from .ann_search import op2_ann_search
from .chat_format import op11_chat_format
from .decontaminate import op1_decontaminate
from .license_scan import op9_license_scan
from .merkle_manifest import op12_merkle_manifest
from .quality_classifier import op10_quality_classifier
from .repeated_spans import op5_repeated_spans
from .secret_scan import op7_secret_scan
from .sentencepiece_lattice import op3_sentencepiece
from .simhash_dedup import op8_simhash_dedup
from .spelling_variants import op13_spelling_variants
from .token_counts import op6_token_counts
from .url_filter import op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_ann_search": op2_ann_search,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_url_filter": op4_url_filter,
        "op5_repeated_spans": op5_repeated_spans,
        "op6_token_counts": op6_token_counts,
        "op7_secret_scan": op7_secret_scan,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_chat_format": op11_chat_format,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_chat_format": oracle.CHAT,
        "op12_merkle_manifest": oracle.MERKLE,
        "op13_spelling_variants": oracle.SPELLING,
    }
