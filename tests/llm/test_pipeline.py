"""The corpus pipeline, stage by stage, over a small folder with odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fathom.llm import neardup
from tests.llm.conftest import ODD, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = frame(spark, [(9_000_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in ODD])
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("score", F.lit(2)).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
            assert docs.count() > 0.5 * before.count(), name
        if name == "language":
            assert docs.where("text is null or not rlike(text, '[a-zA-Z]')").where("not rlike(text, '\\\\p{L}')").count() == 0
        if name == "near-duplicates":
            marks = neardup.near_duplicates(before, words=5, percent=80)
            want = {r.component_id for r in marks.where("doc_id is not null").collect()}
            assert {r.doc_id for r in docs.where("doc_id is not null").collect()} == want
        if name == "mixture":
            assert docs.groupBy("doc_id", "text").count().agg(F.max("count")).head()[0] <= 6
    assert docs.where("length > 4096").count() == 0


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/e{i}")
        docs = spark.read.parquet(f"{tmp_path}/e{i}")
        assert docs.count() == 0


def test_run(spark, folder):
    assert cp.run(spark, folder).count() > 0
