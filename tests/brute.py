"""Plain-Python scoring, to compare the Spark plans with."""

from __future__ import annotations

import math
from collections import Counter


def tokens_of(rows):
    return {docid: content.split() for docid, content in rows}


def stats_of(docs):
    df, cf = Counter(), Counter()
    for tokens in docs.values():
        cf.update(tokens)
        df.update(set(tokens))
    return df, cf


def bm25(docs, queries, k1=1.0, b=0.5, avgdl=450.0, n=None):
    df, _ = stats_of(docs)
    n = len(docs) if n is None else n
    out = {}
    for qid, words in queries.items():
        for docid, tokens in docs.items():
            tf = Counter(tokens)
            score = 0.0
            for w in words:
                if w in df and tf[w]:
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5))
                    score += idf * (k1 + 1) * tf[w] / (k1 * (1 - b + b * len(tokens) / avgdl) + tf[w])
            out[qid, docid] = score
    return out


def likelihood(docs, queries, smoothing, background="df"):
    df, cf = stats_of(docs)
    size = sum(cf.values())
    base = df if background == "df" else cf
    out = {}
    for qid, words in queries.items():
        words = {w for w in words if w in df}
        for docid, tokens in docs.items():
            tf = Counter(tokens)
            if not any(tf[w] for w in words):
                continue
            score = 0.0
            for w in words:
                p = base[w] / size
                if smoothing <= 1:
                    prob = smoothing * tf[w] / len(tokens) + (1 - smoothing) * p
                else:
                    prob = (tf[w] + smoothing * p) / (len(tokens) + smoothing)
                score += math.log(prob) if prob > 0 else float("-inf")
            out[qid, docid] = score
    return out


def ranked(scores, k, reverse_ties=False):
    """{qid: [(docid, score)]} of the k best, ties by docid."""
    out = {}
    for qid in sorted({q for q, _ in scores}):
        rows = [(d, round(s, 6)) for (q, d), s in scores.items() if q == qid]
        rows.sort(key=lambda r: r[0], reverse=reverse_ties)
        rows.sort(key=lambda r: -r[1])
        out[qid] = rows[:k]
    return out
