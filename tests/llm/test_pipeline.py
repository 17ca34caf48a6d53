"""The stages in order, each held against its operator's definition."""

import corpus_pipeline as P
import pytest
import sentencepiece
from cohortspark.llm import decontaminate, quality_classifier, secret_scan, simhash_dedup
from cohortspark.llm.common import read
from helpers import awkward, frame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_run_matches_the_operators_applied_by_hand(spark):
    docs = read(spark, SF, "documents").collect()
    scores = {r.doc_id: r.predicted for r in quality_classifier.op10_quality_classifier(spark, SF).collect()}
    left = [d for d in docs if scores[d.doc_id]]
    classes = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(left)).collect()}
    left = [d for d in left if classes[d.doc_id] == d.doc_id]
    leaks = {r.doc_id for r in decontaminate.contaminations(spark.createDataFrame(left), read(spark, SF, "benchmark")).collect()}
    left = [d for d in left if d.doc_id not in leaks]
    found = {r.doc_id: r.spans for r in secret_scan.secrets(spark.createDataFrame(left), secret_scan.OWNER, secret_scan.REPOSITORY).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for d in left:
        text, at, out = d.text, 0, ""
        for s in found[d.doc_id]:
            if s.live:
                out += text[at : s.start] + "[SECRET]" if s.start >= at else ""
                at = max(at, s.stop)
        want[d.doc_id] = library.encode(out + text[at:])
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == want and all(r.round_trip for r in got.values())
    assert 0 < len(got) < len(docs)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    assert [len(P.STAGES), len({n for n, _ in P.STAGES})] == [5, 5]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.columns[0] == "doc_id" and docs.where(~F.col("round_trip")).count() == 0


def test_stages_take_no_documents(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registry_has_every_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
