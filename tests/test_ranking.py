from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from scanmill.functions.text import get_analyzer
from scanmill.operators import queries as Q
from scanmill.operators import ranking
from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.ranking import bm25_topk, lm_topk, top_k
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import build_doc_vectors, to_unique_vectors
from scanmill.runtime import written
from scanmill.sinks.text import run_lines
from scanmill.sources.tables import parse_query_lines, rejected_query_lines
from tests import brute

WORDS = get_analyzer("standard", [])


def prepare(docs):
    terms = build_dictionary(compute_term_statistics(docs, WORDS, 1, html=False))
    vectors = written(build_doc_vectors(docs, terms, WORDS, html=False, row_key=["docid"]))
    return docs, terms, vectors, brute.tokens_of([tuple(r) for r in docs.select("docid", "content").collect()])


@pytest.fixture(scope="module")
def small(corpus):
    return prepare(corpus)


@pytest.fixture(scope="module")
def wide(spark):
    """300 documents, in 200 of which one word occurs; skewed words, ties, empties."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = ["hot"] * rng.randrange(1, 4) if i % 3 else []
        words += [f"w{int(rng.paretovariate(0.6)) % 50}" for _ in range(rng.randrange(0, 30))]
        rows.append((f"doc{i:03d}", " ".join(words)))
    return prepare(spark.createDataFrame(rows, "docid string, content string"))


ASKED = {
    1: "apple banana",
    2: "apple apple cherry",
    3: "unknown",
    4: "grape unknown fig",
    5: "date",
    6: "zebra hot w1 w2 w2",
}


def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "qid int, text string")


def result(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        rows = out.setdefault(r.qid, [])
        rows.append((r.docid, r.score))
        assert r.rank == len(rows)
    return out


def same(got, expected):
    expected = {q: rows for q, rows in expected.items() if rows}
    assert got.keys() == expected.keys()
    for qid, rows in expected.items():
        assert [d for d, _ in got[qid]] == [d for d, _ in rows], qid
        for (_, a), (_, b) in zip(got[qid], rows):
            assert a == b or a == pytest.approx(b, abs=2e-6)


QUERIES = {q: t.split() for q, t in ASKED.items()}


def test_hand_computed_scores(spark, small):
    _, terms, vectors, _ = small
    got = result(bm25_topk(vectors, terms, asked(spark), 10, WORDS))
    # banana is in 3 of 9 documents, apple in 3.  d2: tf 2, 3 words.
    idf = math.log((9 - 3 + 0.5) / 3.5)
    norm = 0.5 + 0.5 * 3 / 450
    assert dict(got[1])["d2"] == pytest.approx(idf * 2 * 2 / (norm + 2), abs=1e-6)
    # A repeated query word counts twice.
    norm = 0.5 + 0.5 * 1 / 450
    assert dict(got[2])["d3"] == pytest.approx(2 * idf * 2 / (norm + 1), abs=1e-6)
    # Equal documents rank by id.
    assert [d for d, _ in got[1]][:3].index("d6") == [d for d, _ in got[1]][:3].index("d2") + 1
    got = result(lm_topk(vectors, terms, asked(spark), 10, 10.0, WORDS))
    size = 3 + 3 + 4 + 1 + 0 + 5 + 3 + 3 + 3 - 0
    assert dict(got[5])["d2"] == pytest.approx(math.log((1 + 10 * 3 / size) / 13), abs=1e-6)
    got = result(lm_topk(vectors, terms, asked(spark), 10, 0.5, WORDS))
    assert dict(got[5])["d2"] == pytest.approx(math.log(0.5 / 3 + 0.5 * 3 / size), abs=1e-6)


@pytest.mark.parametrize("which, unique", [("small", False), ("wide", True)])
def test_bm25_matches_brute_force(spark, request, which, unique):
    _, terms, vectors, docs = request.getfixturevalue(which)
    vectors = to_unique_vectors(vectors) if unique else vectors
    scores = brute.bm25(docs, QUERIES)
    positive = {p: s for p, s in scores.items() if round(s, 6) > 0}
    same(result(bm25_topk(vectors, terms, asked(spark), 7, WORDS)), brute.ranked(positive, 7))
    got = bm25_topk(vectors, terms, asked(spark), 7, WORDS, tie="docid_desc")
    same(result(got), brute.ranked(positive, 7, reverse_ties=True))
    lengths = [len(t) for t in docs.values()]
    got = bm25_topk(
        vectors, terms, asked(spark), 5, WORDS, k1=1.2, b=0.75, average_length=None, n_docs=1000
    )
    scores = brute.bm25(docs, QUERIES, 1.2, 0.75, sum(lengths) / len(lengths), 1000)
    same(result(got), brute.ranked({p: s for p, s in scores.items() if round(s, 6) > 0}, 5))


@pytest.mark.parametrize("k, tie", [(3, "docid"), (120, "docid_desc"), (400, "docid")])
def test_all_documents_take_part(spark, wide, monkeypatch, k, tie):
    _, terms, vectors, docs = wide
    zeros = ranking._zero_scores
    monkeypatch.setattr(ranking, "_zero_scores", lambda *a: zeros(*a, block=k))
    got = bm25_topk(vectors, terms, asked(spark), k, WORDS, positive_only=False, tie=tie)
    expected = brute.ranked(brute.bm25(docs, QUERIES), k, reverse_ties=tie == "docid_desc")
    assert k < 400 or any(s < 0 for rows in expected.values() for _, s in rows)
    same(result(got), expected)


@pytest.mark.parametrize("k", [3, 400])
def test_all_scores_are_kept_only_for_queries_short_of_positive_ones(spark, wide, monkeypatch, k):
    _, terms, vectors, docs = wide
    scan, cuts, filled = ranking.bm25_scores, [], []

    def scores_of(*args, **options):
        qids = {r.qid for r in args[1].select("qid").distinct().collect()}
        cuts.append((args[6], qids))
        return scan(*args, **options)

    zeros = ranking._zero_scores

    def zeros_of(scores, vectors, rest, *args):
        filled.extend(r.qid for r in rest.collect())
        return zeros(scores, vectors, rest, *args)

    monkeypatch.setattr(ranking, "bm25_scores", scores_of)
    monkeypatch.setattr(ranking, "_zero_scores", zeros_of)
    words = {1: "hot", 2: "w40 w41 w42 w43", 3: "unknown", 4: "w30"}
    queries = spark.createDataFrame(list(words.items()), "qid int, text string")
    got = bm25_topk(vectors, terms, queries, k, WORDS, positive_only=False)
    exact = brute.bm25(docs, {q: text.split() for q, text in words.items()})
    same(result(got), brute.ranked(exact, k))
    short = {q for q in words if sum(round(exact[q, d], 6) > 0 for d in docs) < k}
    assert set(filled) == short
    assert all(qids <= short for best, qids in cuts if best is None)
    assert short == {1, 3} if k == 3 else short > {1, 3}


def test_small_blocks_of_unmatched_documents(spark, wide):
    _, terms, vectors, docs = wide
    prepared = Q.prepare_queries(asked(spark), terms, WORDS)
    scores = written(ranking.bm25_scores(vectors, prepared, F.lit(300)))
    zeros = ranking._zero_scores(scores, vectors, asked(spark), 4, "docid", block=4)
    got = {}
    for r in zeros.orderBy("qid", "docid").collect():
        got.setdefault(r.qid, []).append(r.docid)
    for qid, words in QUERIES.items():
        free = sorted(d for d, tokens in docs.items() if not set(words) & set(tokens))
        assert got[qid] == free[:4]


@pytest.mark.parametrize(
    "smoothing, background", [(0.0, "df"), (0.3, "cf"), (1.0, "df"), (1.5, "cf"), (1000.0, "df")]
)
def test_likelihood_matches_brute_force(spark, wide, small, smoothing, background):
    for _, terms, vectors, docs in (wide, small):
        got = lm_topk(vectors, terms, asked(spark), 9, smoothing, WORDS, background)
        expected = brute.ranked(brute.likelihood(docs, QUERIES, smoothing, background), 9)
        same(result(got), expected)


def test_options_are_checked(spark, small):
    _, terms, vectors, _ = small
    with pytest.raises(ValueError):
        lm_topk(vectors, terms, asked(spark), 1, background="idf")
    with pytest.raises(ValueError):
        bm25_topk(vectors, terms, asked(spark), 1, tie="random")


def test_deep_ranking_beyond_the_group_limit(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 2).cast("int").alias("qid"),
        F.format_string("d%05d", "id").alias("docid"),
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("score"),
    )
    got = top_k(rows, 1500)
    best = sorted(((-r.score, r.docid) for r in rows.filter("qid = 1").collect()))[:1500]
    assert [(-s, d) for d, s in result(got)[1]] == best
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter("qid = 0").agg(F.min("rank"), F.max("rank"), F.count("*")).first()[:] == (1, 1500, 1500)


def test_scores_do_not_depend_on_partitioning(spark, wide):
    _, terms, vectors, _ = wide
    runs = [
        result(bm25_topk(v, terms, asked(spark), 50, WORDS, row_key=["docid"]))
        for v in (vectors.repartition(1), vectors.repartition(13))
    ]
    assert runs[0] == runs[1]


def test_dictionary_of_a_larger_corpus(spark, wide):
    """A term more frequent than the scanned documents are many gets a finite score."""
    _, terms, vectors, _ = wide
    got = bm25_topk(
        vectors.filter("docid < 'doc010'"), terms, asked(spark), 5, WORDS, positive_only=False
    )
    assert all(math.isfinite(s) for rows in result(got).values() for _, s in rows)


def test_query_lines(spark):
    lines = ["15:espn sports", "16:a: b", "no number", "x:y", " 17 :z", "99999999999:big", "9223372036854775808:beyond", ""]
    got = parse_query_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.qid: r.text for r in got.collect()} == {
        15: "espn sports", 16: "a: b", 17: "z", 99999999999: "big"
    }


def test_rejected_query_lines(spark):
    lines = ["15:espn", "no number", "x:y", " : z", "9223372036854775808:beyond", "", "  ", "-3:minus"]
    got = rejected_query_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r.line: r.reason for r in got.collect()} == {
        "no number": "no colon", "x:y": "no number", " : z": "no number", "-3:minus": "no number",
        "9223372036854775808:beyond": "number beyond 64 bits",
    }


def test_run_lines(spark):
    run = spark.createDataFrame([(7, "d", 1, 2.5, "bm25")], "qid int, docid string, rank int, score double, tag string")
    assert run_lines(run).first().value == "7 Q0 d 1 2.5 bm25"
