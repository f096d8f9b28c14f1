from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanmill.llm import quality
from scanmill.llm.quality import STATISTICS, Gaussian, classify_quality, text_statistics
from scanmill.llm.textscan import blocks

GOOD = "The cat sat on the mat, and looked at number {} of the birds. It was a fine day."
BAD = "BUY!! NOW!! {}%%% ###free$$$ | win | {} | cash***"


def test_density_is_that_of_the_covariance():
    rng = np.random.default_rng(1)
    root = rng.normal(size=(4, 4))
    covariance, mean = root @ root.T + np.eye(4), rng.normal(size=4)
    x = rng.normal(size=(9, 4))
    found = Gaussian.of(mean, covariance).log_density(x)
    d = x - mean
    expected = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d)
    expected -= 0.5 * np.linalg.slogdet(covariance)[1]
    assert found == pytest.approx(expected)


def test_statistics_do_not_depend_on_the_batch(spark):
    texts = [GOOD.format(1), None, "", "x", BAD.format(1, 2), "é" * 30, "\n\n a a  a"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {r.doc_id: r.statistics for r in text_statistics(docs.coalesce(1)).collect()}
    alone = {r.doc_id: r.statistics for r in text_statistics(docs.repartition(7)).collect()}
    assert whole == alone and whole[1] == whole[2] and len(whole[1]) == len(STATISTICS)


def test_learns_and_scores_every_row(spark):
    rows = [(i, (GOOD if i % 2 else BAD).format(i, i), "x") for i in range(60)]
    rows += [(60, None, "x"), (61, "", "x"), (None, GOOD.format(1, 1), "x"), (1, GOOD.format(1, 1), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    marks = [(i, i % 2) for i in range(40)] + [(3, 1), (5, None), (7, 9), (None, 0), (999, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    found = classify_quality(docs, labels, F.col("doc_id") % 5 != 0)
    assert found.columns == ["doc_id", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)


@pytest.mark.parametrize("marks, score", [([], 0.5), ([(1, 1), (2, 1)], 1.0)])
def test_without_both_classes(spark, marks, score):
    docs = spark.createDataFrame([(1, "a text"), (2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    assert [r.score for r in classify_quality(docs, labels, F.lit(True)).collect()] == [score, score]
    assert classify_quality(docs.limit(0), labels, F.lit(True)).collect() == []


def test_pieces_of_a_long_text_give_the_statistics_of_the_whole(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("ab É\n.#X12,'") for _ in range(rng.randint(1, 40))) for _ in range(900))
    (block,) = blocks(pa.array([text]))
    whole = quality._statistics(block)
    for size in (50, 1000, 9000):
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        assert (quality._statistics(block) == whole).all()


def test_memory_of_a_long_text_is_bounded():
    (block,) = blocks(pa.array(["word! " * 4_000_000]))
    tracemalloc.start()
    quality._statistics(block)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
