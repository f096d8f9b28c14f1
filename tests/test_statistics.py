from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scanmill.operators.documents import corpus_health, observe_health, with_status
from scanmill.operators.statistics import (
    compute_term_statistics,
    merge_replacing,
    merge_term_statistics,
    term_frequencies,
)
from scanmill.runtime import written
from scanmill.sinks.tables import write_segments
from scanmill.sources.tables import TERM_STATISTICS, read_segments
from tests.brute import stats_of, tokens_of


def as_dict(stats):
    return {r.term: (r.df, r.cf) for r in stats.collect()}


def test_counts_match_brute_force(spark, corpus):
    docs = tokens_of([tuple(r) for r in corpus.collect()])
    df, cf = stats_of(docs)
    got = as_dict(compute_term_statistics(corpus, "standard", 1, html=False))
    assert got == {t: (df[t], cf[t]) for t in df}
    assert as_dict(compute_term_statistics(corpus, "standard", 3, 3, html=False)) == {
        t: (df[t], cf[t]) for t in df if df[t] == 3
    }
    tf = {(r.docid, r.term): r.tf for r in term_frequencies(corpus, "standard", html=False).collect()}
    assert tf["d1", "apple"] == 2 and tf["d7", "zebra"] == 3 and ("d4", "") not in tf


def test_default_threshold_is_one_hundred(spark):
    docs = spark.range(100).select(F.col("id").cast("string").alias("docid"), F.lit("<p>hot</p>").alias("content"))
    assert as_dict(compute_term_statistics(docs, "standard")) == {"hot": (100, 100)}
    assert as_dict(compute_term_statistics(docs.limit(99), "standard")) == {}


def test_length_caps(spark):
    rows = [
        ("a", "x" * 64 + " " + "y" * 65),
        ("b", "z " * 262_144),
        ("c", "w " * 262_144 + "w"),
        (None, "lost"),
        ("e", None),
    ]
    docs = spark.createDataFrame(rows, "docid string, content string")
    got = as_dict(compute_term_statistics(docs, "standard", 1, html=False))
    assert got == {"x" * 64: (1, 1), "z": (1, 262_144)}
    status = {r.docid: r.status for r in with_status(docs).collect()}
    assert status == {"a": "ok", "b": "ok", "c": "too_long", None: "no_docid", "e": "error"}
    health = corpus_health(docs).first().asDict()
    assert health == {"total": 5, "pages": 4, "errors": 1, "too_long": 1}
    marked, seen = observe_health(docs, "test_caps")
    marked.write.format("noop").mode("overwrite").save()
    assert seen.get == health


def test_merge_loses_terms_that_segments_dropped(spark):
    schema = "docid string, content string"
    one = spark.createDataFrame([("1", "rare common"), ("2", "common")], schema)
    two = spark.createDataFrame([("3", "rare common"), ("4", "common")], schema)

    def merged(segment_min):
        segments = [compute_term_statistics(s, "standard", segment_min, html=False) for s in (one, two)]
        return as_dict(merge_term_statistics(*segments, df_min=2))

    assert merged(2) == {"common": (4, 4)}
    assert merged(1) == {"common": (4, 4), "rare": (2, 2)}


def test_unknown_analyzer(corpus):
    with pytest.raises(ValueError):
        compute_term_statistics(corpus, "none")


def test_one_segment_is_replaced(spark, tmp_path):
    """Only that segment's folder changes, reading it touches no other, and the totals follow."""
    path = tmp_path / "segments"

    def stats(*rows):
        return spark.createDataFrame(rows, "segment string, term string, df bigint, cf bigint")

    write_segments(stats(("a", "x", 2, 3), ("a", "y", 1, 1), ("b", "x", 4, 9), ("c", "z", 1, 1)), str(path))
    files = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    merged = written(merge_term_statistics(read_segments(spark, str(path), TERM_STATISTICS), df_min=1))
    new = written(stats(("b", "x", 1, 2), ("b", "w", 5, 5)))
    old = read_segments(spark, str(path), TERM_STATISTICS, "b")
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "b)" in plan
    totals = written(merge_replacing(merged, old, new))
    write_segments(new, str(path))
    again = merge_term_statistics(read_segments(spark, str(path), TERM_STATISTICS), df_min=1)
    expected = {"x": (3, 5), "y": (1, 1), "z": (1, 1), "w": (5, 5)}
    for table in (totals, again):
        assert {r.term: (r.df, r.cf) for r in table.collect()} == expected
    left = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    changed = {f.parent.name for f, t in (files.items() ^ left.items())}
    assert changed == {"segment=b"}
    # A term that no segment holds any more is gone; an empty new segment takes all off.
    none = merge_replacing(totals, read_segments(spark, str(path), TERM_STATISTICS, "b"), new.limit(0))
    assert {r.term for r in none.collect()} == {"x", "y", "z"}
