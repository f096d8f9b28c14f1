from __future__ import annotations

import random
import re
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from scanmill.llm import ngram_join
from scanmill.llm.graphs import components
from scanmill.llm.ngram_join import keep_one_of_each, near_duplicates
from scanmill.runtime import BATCH_ROWS


def brute(rows, words, num, den):
    """Component of each row, from all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    live = [i for i, (doc, _) in enumerate(rows) if doc is not None and sets[i]]
    for i, j in combinations(live, 2):
        both = len(sets[i] & sets[j])
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i in live:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(
        (repr(doc), len(sets[i]), repr(least[root(i)] if i in live else doc)) for i, (doc, _) in enumerate(rows)
    )


def corpus(seed, groups, size):
    """Groups of edited copies, in chains and stars, and unrelated texts with common phrases."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    phrase = [f"p{i}" for i in range(15)]
    rows, doc = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(20, 90))
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = phrase + text
            if rng.random() < 0.3:
                base = text
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc + 1, None), (doc + 2, ""), (doc + 3, " \n "), (None, rows[0][1]), (doc + 4, "W1 w2"), (doc + 5, "w1\tw2")]
    rows += [rows[3], (rows[4][0], rows[8][1]), (rows[1][0], "another text with the same id")]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS component_id")
    result = near_duplicates(docs, **options)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in result.collect())


@pytest.mark.parametrize("words, threshold", [(3, (9, 10)), (5, (4, 5))])
def test_equals_all_pairs(spark, words, threshold):
    rows = corpus(words, 40, 8)
    assert found(spark, rows, words=words, threshold=threshold) == brute(rows, words, *threshold)


def test_blocks_of_large_groups(spark, monkeypatch):
    """Lists beyond SHORT_LIST, clusters of several blocks, and strays that meet all blocks."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    rows = corpus(9, 6, 60)
    assert found(spark, rows, words=3, threshold=(9, 10)) == brute(rows, 3, 9, 10)


def test_empty_table_and_long_text(spark):
    assert found(spark, [], words=3) == []
    text = " ".join(f"x{i}" for i in range(200_000))
    rows = [(2, text), (1, text + " end"), (3, "other")]
    assert found(spark, rows) == [("1", 199_997, "1"), ("2", 199_996, "1"), ("3", 1, "3")]


def test_one_of_each_stays(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(5, text), (2, text + " y"), (2, text + " y"), (9, "z"), (None, text), (7, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = keep_one_of_each(docs).collect()
    assert sorted((repr(r.doc_id), r.text or "") for r in kept) == sorted(
        [("2", text + " y"), ("9", "z"), ("None", text), ("7", ""), ("8", "")]
    )


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(300, 300), (61, 60), (61, 60)]
    edges = spark.createDataFrame(chain, "a int, b int")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 1 for i in range(1, 62)} | {i: 100 for i in range(100, 140)}
    assert components(edges.limit(0)).collect() == []


def test_postings_come_in_small_batches_and_copies_once(spark, monkeypatch):
    """However many rows a task is given at once, it holds few of their postings."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(40)]
    rows = pa.RecordBatch.from_pydict({"doc": list(range(80)), "text": texts + texts})
    monkeypatch.setattr(ngram_join, "_POSTINGS", 200)
    order = SimpleNamespace(value=ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    taken = SimpleNamespace(mapInArrow=lambda run, ddl: run)
    run = ngram_join._postings(taken, 5, (4, 5), order)
    found = list(run(iter([rows.slice(0, 40), rows.slice(40)])))
    assert len(found) > 1 and all(b.num_rows < 200 + 120 for b in found)
    nodes = [n for b in found for n, p in zip(b["node"].to_pylist(), b["pos"].to_pylist()) if p == 0]
    assert len(nodes) == len(set(nodes)) == 40


def test_pipeline_stages_bound_the_rows_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for asked, held in ((None, BATCH_ROWS), (7, 7)):
        session = spark.newSession()
        if asked:
            session.conf.set(key, asked)
        corpus_pipeline.drop_repeated_lines(session, docs, "")
        assert session.conf.get(key) == str(held)


def test_lists_spread_thinly_over_tasks_come_late(spark, monkeypatch):
    """Shingles that no task sees often are long lists all the same, and must not bind unrelated sets."""
    rng = random.Random(11)
    phrases = [" ".join(f"p{i}_{j}" for j in range(6)) for i in range(40)]
    rows = []
    for doc in range(240):
        parts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(3)) for _ in range(30)]
        parts += rng.sample(phrases, 20)
        rng.shuffle(parts)
        rows.append((doc, " ".join(parts)))
    rows.append((900, rows[7][1] + " end"))
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "_FLUSH", 1)
    chosen, prefixes = [], ngram_join._chosen_prefixes
    monkeypatch.setattr(ngram_join, "_chosen_prefixes", lambda *a: chosen.append(prefixes(*a)) or chosen[-1])
    assert found(spark, rows, words=3, threshold=(9, 10)) == brute(rows, 3, 9, 10)
    assert chosen[0].filter("bound").isEmpty()
