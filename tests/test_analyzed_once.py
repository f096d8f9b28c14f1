"""Statistics and vectors of one collection share its tokens."""

from __future__ import annotations

import pytest
from suite import base

from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.documents import analyzed
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import build_doc_vectors

ROWS = [
    ("a", "The cats, running: cats ran"), ("a", "The cats, running: cats ran"), ("b", ""), ("c", None),
    (None, "cats without an id"), ("d", "x" * 300 + " cats"), ("e", "too long " * 40), ("f", "runs the 3,14 of it"),
]


@pytest.mark.parametrize("analyzer", ["standard", "porter"])
def test_statistics_and_vectors_of_the_shared_tokens(spark, analyzer):
    docs = spark.createDataFrame(ROWS, "docid string, content string")
    once = analyzed(docs, analyzer, html=False, max_chars=310)
    assert once.columns == ["docid", "status", "tokens"]
    stats = [compute_term_statistics(d, analyzer, 1, html=False, max_chars=310) for d in (docs, once)]
    assert sorted(stats[0].collect()) == sorted(stats[1].collect())
    terms = build_dictionary(stats[0])
    vectors = [build_doc_vectors(d, terms, analyzer, html=False, max_chars=310) for d in (docs, once)]
    assert sorted(vectors[0].collect()) == sorted(vectors[1].collect()) and vectors[1].count() == 7


@pytest.mark.parametrize("name", ["postings", "bm25_deep", "run_file", "lm_jelinek_mercer", "doc_vectors_porter"])
def test_queries_analyze_a_text_once(spark, tmp_path, monkeypatch, name):
    from scanmill.functions.text import Analyzer
    from suite.catalog import REGISTRY

    docs = spark.createDataFrame([(i, "apple banana " * (i + 1) if i < 2 else "cherry date") for i in range(6)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.createDataFrame([(1, "apple pear")], "item_id bigint, text string")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    analyzed_columns, tokens = [], Analyzer.tokens

    def counted(self, text):
        analyzed_columns.append(str(text))
        return tokens(self, text)

    monkeypatch.setattr(Analyzer, "tokens", counted)
    assert base.DF_MIN == 2 and REGISTRY[name].run(spark, str(tmp_path)).count() > 0
    assert sum("content" in column for column in analyzed_columns) == 1
