"""Dictionaries beyond what is shared: the rest is shuffled, and never broadcast."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanmill.functions import lookup
from scanmill.operators.vectors import build_doc_vectors, decode_doc_vectors, encode_tokens
from scanmill.sinks.tables import write_doc_vectors
from scanmill.sources.tables import read_doc_vectors


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [[f"w{int(rng.paretovariate(0.6)) % 700}" for _ in range(rng.randrange(60))] for _ in range(300)]
    return [*made, [], ["w1", "w1", "zz", "w2"], ["zz"]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # Ids repeat: rows are told apart without a key.
    rows = [(f"d{i % 50}", " ".join(ws)) for i, ws in enumerate(texts)]
    return spark.createDataFrame(rows, "docid string, content string").repartition(3)


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(i + 1, f"w{i}", 5, 5) for i in range(600)]
    return spark.createDataFrame(rows, "term_id int, term string, df long, cf long")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_rest_of_a_dictionary_is_not_broadcast(docs, terms):
    vectors = build_doc_vectors(docs, terms, "standard", html=False, broadcast_terms=20)
    counted = vectors.agg(F.count(F.lit(1)).alias("n"))
    decoded = decode_doc_vectors(vectors, terms, broadcast_terms=20)
    for df in (vectors, counted, decoded):
        plan = _plan(df)
        assert "BroadcastExchange" not in plan and "ObjectHashAggregate" not in plan


def test_stems_beyond_the_head_are_not_collected_by_row(docs, terms):
    near, far = (build_doc_vectors(docs, terms, "porter", html=False, broadcast_terms=n) for n in (10**6, 20))
    plan = _plan(far)
    assert "BroadcastExchange" not in plan and "ObjectHashAggregate" not in plan
    rows = lambda df: sorted((r.docid, r.term_ids, r.doc_len) for r in df.collect())
    assert rows(far) == rows(near)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_rows_that_share_an_id_keep_their_own_tokens(spark, docs, terms, texts, batch, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, batch)
    request.addfinalizer(lambda: spark.conf.unset(key))
    ids = {f"w{i}": i + 1 for i in range(600)}
    expected = sorted((f"d{i % 50}", [ids[w] for w in ws if w in ids]) for i, ws in enumerate(texts))
    vectors = build_doc_vectors(docs, terms, "standard", html=False, broadcast_terms=20)
    assert sorted((r.docid, r.term_ids) for r in vectors.collect()) == expected
    words = sorted((d, [f"w{i - 1}" for i in found]) for d, found in expected)
    decoded = decode_doc_vectors(vectors, terms, broadcast_terms=20)
    assert sorted((r.docid, r.terms) for r in decoded.collect()) == words


def test_nulls_and_unknown_ids(spark, terms):
    rows = [("a", ["w1", None, "w500", "?"], 7), ("b", None, None), (None, ["w599"], 1)]
    some = spark.createDataFrame(rows, "docid string, tokens array<string>, other int")
    coded = encode_tokens(some, terms, ["docid", "other"], broadcast_terms=20)
    assert {(r.docid, r.other, tuple(r.term_ids)) for r in coded.collect()} == {
        ("a", 7, (2, 501)), ("b", None, ()), (None, 1, (600,)),
    }
    ids = spark.createDataFrame([("a", [2, None, 501, 9000, -1, 0]), ("b", None)], "docid string, term_ids array<int>")
    for limit in (20, 1000):
        decoded = decode_doc_vectors(ids, terms, broadcast_terms=limit).collect()
        assert {(r.docid, tuple(r.terms)) for r in decoded} == {("a", ("w1", "w500")), ("b", ())}


def test_columns_are_worked_on_in_portions(monkeypatch):
    monkeypatch.setattr(lookup, "PORTION", 4)
    index = lookup.TermIndex.of(pa.array(["a", "b", "c"]), pa.array([1, 2, 3]).to_numpy())
    lists = pa.array([["a", "?"], ["b", "c", "a"], None, [], ["c"] * 9, ["b", None]])
    seen = []

    def change(part):
        seen.append(len(part.flatten()))
        return index.encode(part)

    assert lookup.in_portions(lists[1:], change).to_pylist() == [[2, 3, 1], [], [], [3] * 9, [2]]
    assert seen == [3, 9, 2]
    assert lookup.in_portions(lists[:0], index.encode).to_pylist() == []


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    vectors = spark.range(0, 20_000, 1, 8).selectExpr(
        "cast(id as string) docid", "transform(sequence(1, 30), x -> cast(hash(id, x) as int)) term_ids", "30 doc_len"
    )
    path = str(tmp_path / "vectors")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "100k")
    try:
        write_doc_vectors(vectors, path, partitions=2)
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "vectors" / "buckets=2").glob("*.parquet"))) > 4
    back = read_doc_vectors(spark, path)
    assert back.exceptAll(vectors).isEmpty() and back.count() == 20_000
    assert "Exchange" not in back.groupBy("docid").count()._jdf.queryExecution().sparkPlan().toString()


def test_rows_of_one_named_key_are_one_document_to_the_tail(spark, terms):
    """As before portions: what the tail has for one row of a key is in all of its rows."""
    rows = [("a", ["w1", "w500", "w2"]), ("a", ["w1", "w500", "w2"]), ("b", ["w501", "w3"]), (None, ["w502"]), (None, ["w4"])]
    some = spark.createDataFrame(rows, "docid string, tokens array<string>")
    coded = encode_tokens(some, terms, ["docid"], ["docid"], broadcast_terms=20)
    expected = [("a", [2, 501, 501, 3])] * 2 + [("b", [502, 4]), (None, [503]), (None, [5, 503])]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.docid, r.term_ids) for r in coded.collect()), key=key) == sorted(expected, key=key)
    ids = spark.createDataFrame([("a", [2, 501]), ("a", [2, 501]), ("b", [4])], "docid string, term_ids array<int>")
    decoded = decode_doc_vectors(ids, terms, row_key=["docid"], broadcast_terms=20)
    assert sorted((r.docid, r.terms) for r in decoded.collect()) == [("a", ["w1", "w500", "w500"])] * 2 + [("b", ["w3"])]
