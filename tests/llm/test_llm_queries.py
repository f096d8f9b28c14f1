"""Registered queries against their SQL, held-out accuracy, and the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanmill.llm.queries import REGISTRY

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n, e in REGISTRY.items() if e.sql))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = REGISTRY[name].run(spark, str(SF_DIR))
    answer = connection.execute(REGISTRY[name].sql)
    columns = sorted(result.columns)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    ours = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    order = [names.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=repr)


def test_held_out_accuracy(spark):
    sf_dir = str(SF_DIR.parent / "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    named = REGISTRY["op6_language"].run(spark, sf_dir).filter("held_out").join(docs, "doc_id")
    right, rows = named.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 100 and right >= 0.97 * rows
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = REGISTRY["op3_quality"].run(spark, sf_dir).filter("held_out").join(labels, "doc_id")
    right, rows = judged.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert rows > 30 and right >= 0.93 * rows


def test_pipeline_corrects_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    right = {r.doc_id: r.lang for r in docs.filter("length(text) > 300 and doc_id % 4 = 0").collect()}
    damaged = F.when(F.col("doc_id") % 8 == 0, F.lit(None)).otherwise(F.when(F.col("lang") == "en", "de").otherwise("en"))
    some = (F.col("doc_id") % 4 == 0) & (F.length("text") > 300)
    worse = docs.withColumn("lang", F.when(some, damaged).otherwise(F.col("lang")))
    named = {r.doc_id: r.lang for r in corpus_pipeline.identify(spark, worse, str(SF_DIR)).collect()}
    mended = sum(named[i] == lang for i, lang in right.items() if lang is not None)
    assert len(right) > 20 and mended >= 0.95 * sum(lang is not None for lang in right.values())
    same = {r.doc_id: r.lang for r in corpus_pipeline.identify(spark, docs, str(SF_DIR)).collect()}
    assert all(same[i] == lang for i, lang in right.items() if lang is not None)


def test_pipeline_stages(spark):
    sf_dir = str(SF_DIR)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(10**6, None, "en", "src1", 0), (10**6 + 1, "123 456", "en", "src1", 7), (10**6 + 2, "", None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    ids = {r.doc_id for r in docs.collect()}
    from scanmill.runtime import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "language":
            assert {r.doc_id for r in rows} == ids - {10**6, 10**6 + 1, 10**6 + 2}
        if name == "lines":
            assert len(rows) == len(ids) - 3
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert 0 < len(mixed) <= len(rows) and {r.doc_id for r in mixed} <= {r.doc_id for r in rows}
    spent, there = sum(r.n_tokens * r.n_epochs for r in mixed), sum(len(r.text.split()) for r in rows)
    assert 0.8 * there <= spent <= there
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []
