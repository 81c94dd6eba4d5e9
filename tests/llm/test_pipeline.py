"""The corpus pipeline end to end, stage by stage."""

from __future__ import annotations

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf_dir, documents):
    docs, counts = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns, name
        docs = spark.createDataFrame(out.toPandas(), documents.schema)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > counts[0] // 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1] and last.columns == ["doc_id", "ids", "n_tokens", "decoded", "parity"]
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}


def test_columns_with_the_names_that_stages_use(spark, sf_dir, odd):
    names = ["__lang", "__key", "__id", "__n", "__doubt", "__kept", "__leak"]
    own = odd.selectExpr("*", *(f"doc_id AS `{n}`" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, odd, sf_dir), stage(spark, own, sf_dir)
        assert out.columns == own.columns
        got = sorted(map(str, out.select("doc_id", "text").collect()))
        assert got == sorted(map(str, plain.select("doc_id", "text").collect()))
        assert all(r[n] == r["doc_id"] for r in out.collect() for n in names)


def test_stages_handle_odd_and_empty_rows(spark, sf_dir, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() <= odd.count()
        assert stage(spark, none, sf_dir).count() == 0
