from __future__ import annotations

import random
import re

import numpy as np
import pytest

from scanmill.llm import substring_dedup
from scanmill.llm.fm_index import FMIndex
from scanmill.llm.substring_dedup import dedup_substrings


def brute(rows, window):
    first, texts = {}, []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.append(words)
        if doc is None:
            continue
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    result = []
    for (doc, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        result.append((repr(doc), len(words), len(gone), " ".join(kept)))
    return sorted(result)


def found(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "1 AS rid", "text", "2 AS n_words")
    result = dedup_substrings(docs.repartition(3), window)
    assert result.columns == ["doc_id", "rid", "text", "n_words", "n_removed", "removed_spans"]
    got = result.collect()
    assert all(sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in got)
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.text) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(8, 70))] for _ in range(6)]
    rows = []
    for doc in range(80):
        text = [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(passages) + [word() for _ in range(rng.randrange(0, 12))]
        if doc % 17 == 0:
            text += ["ping", "pong"] * 40 + ["same"] * 50
        rows.append((doc, "  ".join(text)))
    rows += [(200, rows[5][1]), (3, rows[9][1]), rows[7], rows[7], (None, rows[9][1]), (201, None), (202, ""), (203, "\t")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, shard", [(2000, 1 << 20), (3, 100)])
def test_equals_brute_force(spark, monkeypatch, hot, shard):
    """Also with hot anchors, which are split by windows, and many shards."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_SYMBOLS", shard)
    rows = corpus(hot)
    assert found(spark, rows, 20) == brute(rows, 20)


def test_empty_table_long_text_and_windows(spark):
    assert found(spark, [], 20) == []
    text = " ".join(f"x{i}" for i in range(50_000))
    rows = [(1, text), (2, "y " + text), (3, text + " " + text)]
    assert found(spark, rows, 10) == brute(rows, 10)
    with pytest.raises(ValueError):
        dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), 12)


def test_index_counts_occurrences():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(1, 5, rng.integers(0, 30)) for _ in range(40)]
    text = np.concatenate([np.append(s, 0) for s in sequences])
    index = FMIndex(text, 4)
    patterns = rng.integers(1, 5, (300, 4))
    matched, low, high = index.search(patterns)
    whole = text.tolist()

    def places(run):
        return [i for i in range(len(whole)) if whole[i : i + len(run)] == run]

    for pattern, count, a, b in zip(patterns, matched, low, high):
        ends = [pattern[4 - n :].tolist() for n in range(5)]
        assert count == max(n for n in range(5) if n == 0 or len(places(ends[n])) >= 2)
        if count == 4:
            assert sorted(index.places[a:b].tolist()) == places(ends[4])
