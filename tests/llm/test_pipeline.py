import corpus_pipeline
from conftest_llm import SF

from spanlake.llm import common


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialise(stage(spark, docs, SF), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0 < out.count() <= docs.count(), name
            assert out.select("doc_id").distinct().count() == out.count()
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()


def test_no_rows(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), "test")
    assert docs.columns[-2:] == ["sequence_id", "offset"]
