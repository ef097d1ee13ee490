"""The pipeline's stages on the smallest tables: what must stay stays, what must go goes."""

import corpus_pipeline
from folio.llm.common import cut, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, DIR))
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == before and last.where("not round_trip").count() == 0


def test_empty(spark):
    docs = table(spark, DIR, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0
