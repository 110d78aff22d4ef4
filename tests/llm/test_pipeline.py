"""The corpus pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[5] == sizes[4] == sizes[3] < sizes[2] < sizes[0]
    bad = spark.read.parquet(f"{root}/labels.parquet").filter("quality = 0 and toxic = 0")
    assert 4 * docs.join(bad, "doc_id").count() <= bad.count()  # toxic words are too rare in 200 documents to be learnt
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_stages_take_any_column_names(spark, tmp_path):
    """Working names of the stages, dotted names and reserved ones all come through, and empty tables stay empty."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = ["_key", "_heads", "_at", "_id", "_weight", "_toxic", "_rows", "row", "a.b", "name", "spans", "key"]
    wide = docs.limit(60).select("*", *[docs["doc_id"].alias(name) for name in names])
    wide.write.parquet(f"{tmp_path}/docs")
    wide = spark.read.parquet(f"{tmp_path}/docs")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, wide, root)
        assert found.columns == wide.columns, k
        for r in found.select("doc_id", *[f"`{name}`" for name in names]).collect():
            assert set(r) == {r.doc_id}, k
        nothing = stage(spark, wide.limit(0), root)
        assert nothing.columns == wide.columns and nothing.count() == 0, k
