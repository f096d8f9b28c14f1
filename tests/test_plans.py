"""The plans that have to hold at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scanmill.operators import queries as Q
from scanmill.operators import ranking
from scanmill.operators import vectors as vectors_module
from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.ranking import bm25_topk, candidate_terms, lm_topk
from scanmill.operators.statistics import compute_term_statistics, term_frequencies
from scanmill.operators.vectors import build_doc_vectors, decode_doc_vectors, to_unique_vectors
from scanmill.runtime import written
from scanmill.sinks.tables import write_doc_vectors, write_sorted
from scanmill.sources.tables import read_dictionary, read_doc_vectors, read_documents, read_keys


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, corpus):
    docs = written(corpus)
    terms = build_dictionary(compute_term_statistics(docs, "porter", 1, html=False))
    vectors = written(build_doc_vectors(docs, terms, "porter", html=False))
    asked = spark.createDataFrame([(1, "apple banana")], "qid int, text string")
    return docs, terms, vectors, asked


def test_statistics_shuffle_only_combined_terms(stored):
    plan = physical(compute_term_statistics(stored[0], "porter", 1, html=True))
    assert plan.count("Exchange hashpartitioning(term") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan
    # One pass for entities, one for stems: nothing is analyzed twice.
    assert plan.count("ArrowEvalPython") == 2


def test_explode_does_not_repeat_the_analysis(stored):
    assert physical(term_frequencies(stored[0], "porter", html=False)).count("ArrowEvalPython") == 1


def test_vectors_are_coded_and_decoded_inside_the_row(stored):
    docs, terms, vectors, _ = stored
    plan = physical(build_doc_vectors(docs, terms, "porter", html=False))
    # One pass for stems and ids together; no join and nothing exchanged.
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    plan = physical(decode_doc_vectors(vectors, terms))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    beyond = physical(build_doc_vectors(docs, terms, "porter", html=False, broadcast_terms=2))
    assert "_salt" in beyond


@pytest.mark.parametrize("rank", [bm25_topk, lm_topk])
def test_ranking_is_one_scan_with_early_cuts(stored, rank):
    _, terms, vectors, asked = stored
    run = rank(written(to_unique_vectors(vectors)), terms, asked, 10)
    plan = physical(run)
    assert plan.count("WindowGroupLimit") == 2 and "Join" not in plan
    # Documents meet the queries in the row; what is exchanged is what the cut leaves of a query.
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(qid" in exchanges[0]
    below = plan.splitlines()[plan.splitlines().index(exchanges[0]) + 1 :]
    assert "WindowGroupLimit" in "".join(below)


@pytest.mark.parametrize("rank", [bm25_topk, lm_topk])
def test_the_scan_cuts_each_task(spark, corpus, rank):
    """Rows leave the scan only if they may be among the best of their query."""
    many = spark.range(3000).selectExpr(
        "cast(id as string) docid", "concat(repeat('apple ', int(id % 7) + 1), 'cherry banana') content"
    )
    docs = written(many.coalesce(1))
    terms = build_dictionary(compute_term_statistics(docs, "porter", 1, html=False))
    vectors = written(to_unique_vectors(build_doc_vectors(docs, terms, "porter", html=False)))
    asked = spark.createDataFrame([(1, "apple"), (2, "banana cherry"), (3, "nothing")], "qid int, text string")
    prepared = Q.prepare_queries(asked, terms, "porter")
    score = ranking.bm25_scores if rank is bm25_topk else ranking.likelihood_scores
    whole = score(vectors, prepared, F.lit(9000))
    cut = score(vectors, prepared, F.lit(9000), k=5, margin=1e-6)
    assert whole.count() == 6000 and cut.count() < 2500
    expected = ranking.top_k(whole.withColumn("score", F.round("score", 6)), 5).collect()
    assert sorted(ranking.top_k(cut.withColumn("score", F.round("score", 6)), 5).collect()) == sorted(expected)


@pytest.mark.parametrize("rank", [bm25_topk, lm_topk])
def test_large_query_sets_are_ranked_in_groups(spark, stored, monkeypatch, rank):
    _, terms, vectors, asked = stored
    more = asked.union(spark.createDataFrame([(2, "cherry egg"), (3, "zebra")], asked.schema))
    whole = rank(vectors, terms, more, 3).collect()
    monkeypatch.setattr(Q, "BROADCAST_QUERY_BYTES", 40)
    assert not Q.are_small(more)
    run = rank(vectors, terms, more, 3)
    plan = physical(run)
    assert "hashpartitioning(term_id" not in plan and plan.count("WindowGroupLimit") > 2
    assert sorted(map(repr, run.collect())) == sorted(map(repr, whole))


def test_deep_ranking_sorts_no_whole_query(stored):
    _, terms, vectors, asked = stored
    run = bm25_topk(vectors, terms, asked, 3, deep_beyond=2)
    assert "row_number" not in physical(run)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, bm25_topk(vectors, terms, asked, 3).collect()))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(1, "text", "en", "x"), (2, "text", "de", "y")]
    spark.createDataFrame(rows, "id int, body string, lang string, other string").write.partitionBy("lang").parquet(path)
    docs = read_documents(spark, path, "id", "body", segment="lang = 'de'")
    plan = physical(docs)
    assert "PartitionFilters: [isnotnull(lang" in plan and "other" not in plan.split("ReadSchema")[1]
    assert docs.select("docid").first().docid == "2"
    by_column = read_documents(spark, path, "id", "body", segment=F.col("id") > 1)
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in physical(by_column)


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("rank", [bm25_topk, lm_topk])
def test_ranking_stored_vectors_exchanges_no_documents(spark, stored, tmp_path, rank, unique):
    """Over the folder that the job writes, only what is left of each query is shuffled."""
    _, terms, vectors, asked = stored
    twice = vectors.union(vectors.filter("docid = 'd1'"))
    path = str(tmp_path / "it's vectors")
    write_doc_vectors(to_unique_vectors(twice) if unique else twice, path, 3)
    docs = read_doc_vectors(spark, path, unique=unique)
    assert docs.count() == 10 and not [t for t in spark.catalog.listTables() if t.name.startswith("buckets_")]
    run = rank(docs, terms, asked, 10)
    plan = physical(run)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("hashpartitioning(qid" in e for e in exchanges)
    assert "docid" not in "".join(exchanges) and "_doc" not in "".join(exchanges)
    # Records that share an id stay apart.
    assert run.filter("docid = 'd1'").count() == 2
    plain = rank(to_unique_vectors(twice) if unique else twice, terms, asked, 10)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, plain.collect()))


def test_explaining_a_run_is_bounded_by_the_run(stored):
    _, terms, vectors, asked = stored
    run = lm_topk(vectors, terms, asked, 2)
    rows = candidate_terms(run, vectors, Q.prepare_queries(asked, terms, "porter")).collect()
    assert len(rows) == 2 * 2 and {r.tf for r in rows} <= {0, 1, 2}


def test_a_large_dictionary_costs_one_analysis(stored, monkeypatch):
    docs, terms, _, _ = stored
    kept = []
    monkeypatch.setattr(vectors_module, "written", lambda df, name: kept.append(physical(df)) or written(df, name))
    plan = physical(build_doc_vectors(docs, terms, "porter", html=True, broadcast_terms=2))
    # The text of pages, then stems and ids.
    assert len(kept) == 1 and kept[0].count("ArrowEvalPython") == 2 and kept[0].count("Scan parquet") == 1
    assert "ArrowEvalPython" not in plan


def test_a_lookup_reads_few_rows(spark, tmp_path):
    """Of a dictionary in the order of terms, or of ids, only the row groups that may hold a key are read."""
    many = spark.range(200_000).selectExpr(
        "cast(id + 1 as int) term_id", "concat(md5(cast(id as string)), 'x') term", "id df", "id cf"
    )
    by_term, by_id = str(tmp_path / "by-term"), str(tmp_path / "by-id")
    write_sorted(many, by_term, "term", row_group_bytes=64 << 10)
    write_sorted(many, by_id, "term_id", row_group_bytes=64 << 10)
    terms = [r.term for r in many.filter("term_id % 20000 = 7").collect()]
    for path, key, wanted in ((by_term, "term", terms), (by_id, "term_id", [7, 20_007, 150_000, 999_999])):
        found = read_keys(read_dictionary(spark, path), key, wanted)
        rows = found.collect()
        assert {getattr(r, key) for r in rows} == set(wanted) - {999_999}
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        assert read < 200_000 / 10
    with pytest.raises(ValueError):
        read_keys(many, "term_id", list(range(2000)))
    assert read_keys(many, "term_id", []).collect() == []
