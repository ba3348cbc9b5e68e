"""The pipeline's stages, and the queries' registration."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from fretelens.llm import common
from fretelens.llm.queries import QUERIES


def test_stages(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    columns, before = docs.columns, docs.count()
    ids = {r["doc_id"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, SF_SMALL))
        now = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        assert now <= ids, name
        ids = now
        if i < 4:
            assert docs.columns == columns and docs.where(F.trim("text") == "").count() == 0
        if name == "language_id":
            assert docs.count() >= 0.98 * before
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("z")).where("n > 2048 or n <> z").count() == 0


def test_registered():
    names = E.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) <= set(names) and "pipeline" in names


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (2000, 2001), (2000, 2001)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[2001] == 2000
