from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.dumps import dump_plain_text, dump_term_ids
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import (
    build_doc_vectors,
    decode_doc_vectors,
    postings,
    to_unique_vectors,
)
from scanmill.sinks.tables import write_doc_vectors
from scanmill.sources.tables import read_doc_vectors

# Lengths around block borders of the integer codecs that stored such vectors.
LENGTHS = [0, 1, 10, 25, 127, 128, 129, 255, 256, 257, 1024]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    lengths = LENGTHS + [rng.randrange(400) for _ in range(100)]
    return {
        f"doc{i:03d}": [f"w{rng.randrange(500)}" for _ in range(n)] for i, n in enumerate(lengths)
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, " ".join(ws)) for d, ws in texts.items()]
    return spark.createDataFrame(rows, "docid string, content string").repartition(4)


@pytest.fixture(scope="module")
def terms(docs):
    return build_dictionary(compute_term_statistics(docs, "standard", 1, html=False))


@pytest.mark.parametrize("broadcast_terms", [4_000_000, 50])
def test_round_trip(docs, texts, terms, broadcast_terms):
    options = {"row_key": ["docid"], "broadcast_terms": broadcast_terms}
    vectors = build_doc_vectors(docs, terms, "standard", html=False, **options)
    lengths = {r.docid: (r.doc_len, len(r.term_ids)) for r in vectors.collect()}
    assert lengths == {d: (len(ws), len(ws)) for d, ws in texts.items()}
    decoded = decode_doc_vectors(vectors, terms, **options)
    assert {r.docid: r.terms for r in decoded.collect()} == texts


def test_unknown_tokens_are_dropped_in_place(spark, docs, texts, terms):
    small = terms.filter("term_id <= 40")
    known = {r.term for r in small.collect()}
    for limit in (100, 10):
        vectors = build_doc_vectors(
            docs, small, "standard", html=False, row_key=["docid"], broadcast_terms=limit
        )
        decoded = decode_doc_vectors(vectors, small, row_key=["docid"])
        assert {r.docid: r.terms for r in decoded.collect()} == {
            d: [w for w in ws if w in known] for d, ws in texts.items()
        }


def test_unique_vectors(spark, docs, texts, terms):
    ids = {r.term: r.term_id for r in terms.collect()}
    vectors = build_doc_vectors(docs, terms, "standard", html=False, row_key=["docid"])
    unique = {r.docid: (r.doc_len, [(t.term_id, t.tf) for t in r.terms]) for r in to_unique_vectors(vectors).collect()}
    expected = {
        d: (len(ws), sorted(Counter(ids[w] for w in ws).items())) for d, ws in texts.items()
    }
    assert unique == expected
    rows = {(r.docid, r.term_id): (r.tf, r.doc_len) for r in postings(vectors)[0].collect()}
    assert rows == {(d, t): (tf, n) for d, (n, pairs) in expected.items() for t, tf in pairs}


def test_records_that_share_an_id_stay_apart(spark, terms, tmp_path):
    rows = [("same", "w1 w2 w3")] * 5 + [("same", "w4")] + [("other", "w5 w6")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "docid string, content string").write.parquet(path)
    vectors = build_doc_vectors(spark.read.parquet(path), terms, "standard", html=False)
    decoded = decode_doc_vectors(vectors, terms)
    assert sorted((r.docid, " ".join(r.terms)) for r in decoded.collect()) == sorted(rows)


def test_unusable_documents_give_empty_vectors(spark, terms):
    rows = [("ok", "w1 w2"), ("long", "w1 " * 10), ("bad", None), (None, "w1")]
    docs = spark.createDataFrame(rows, "docid string, content string")
    vectors = build_doc_vectors(docs, terms, "standard", html=False, max_chars=20, row_key=["docid"])
    assert {r.docid: r.doc_len for r in vectors.collect()} == {"ok": 2, "long": 0, "bad": 0}
    dump = dump_term_ids(
        docs.union(spark.createDataFrame([("none", "unknown")], docs.schema)),
        terms, html=False, max_chars=20, row_key=["docid"],
    )
    ids = {r.docid: r.ids for r in dump.collect()}
    assert ids["long"] == "" and ids["bad"] == "" and ids["none"] == "[]"
    assert ids["ok"].startswith("[") and ids["ok"].count(", ") == 1
    plain = {r.docid: r.text for r in dump_plain_text(docs, html=False).collect()}
    assert plain == {"ok": "w1|w2", "long": "|".join(["w1"] * 10)}


def test_compacted_files(spark, docs, terms, texts, tmp_path):
    vectors = build_doc_vectors(docs, terms, "standard", html=False, row_key=["docid"])
    path = str(tmp_path / "vectors")
    write_doc_vectors(vectors, path, partitions=3)
    assert [p.name for p in (tmp_path / "vectors").iterdir()] == ["buckets=3"]
    assert len(list((tmp_path / "vectors" / "buckets=3").glob("*.parquet"))) == 3
    write_doc_vectors(vectors, path + "2", partitions=2)
    both = read_doc_vectors(spark, path, path + "2")
    assert both.count() == 2 * len(texts) and both.columns == ["docid", "term_ids", "doc_len"]
    back = read_doc_vectors(spark, path)
    assert {r.docid: r.doc_len for r in back.collect()} == {d: len(ws) for d, ws in texts.items()}
    write_doc_vectors(to_unique_vectors(vectors), path)
    assert read_doc_vectors(spark, path, unique=True).agg(F.sum("doc_len")).first()[0] == sum(
        map(len, texts.values())
    )
