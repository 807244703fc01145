"""Stages of the pipeline called one after the other, with nothing written between them."""

import os

import corpus_pipeline
from twinweave import storage


def test_stages_on_unwritten_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_rows_outlive_later_stages(spark, sf):
    """A stage's rows are computed after others were called, and part of them through a frame made from it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(corpus_pipeline.near_dedup(spark, docs, sf).collect())
    held = corpus_pipeline.near_dedup(spark, docs, sf)
    part = corpus_pipeline.near_dedup(spark, docs, sf).where("doc_id % 2 = 0")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, sf)
    assert sorted(held.collect()) == want
    assert sorted(part.collect()) == [r for r in want if r.doc_id % 2 == 0]


def test_unread_tables_go(spark):
    n = storage.made()
    table = storage.written(spark.range(10), "unread")
    folder = storage._made[n][1].removeprefix("file://")
    made_from_it = table.where("id > 2").join(table.selectExpr("id as other"))
    del table
    assert storage.release([n]) == set() and made_from_it.count() == 70
    del made_from_it
    assert os.path.isdir(folder)
    storage.written(spark.range(1), "later").count()
    assert storage.release([n]) == {n} and not os.path.exists(folder)
