"""The secret scan against Python's regular expressions and a plain version of the models."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scanmill.llm import secret_scan as S
from scanmill.llm.queries import REGISTRY

PLAIN = (
    re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
)


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in PLAIN[1].finditer(text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in PLAIN[2].finditer(text) if len(m.group()) >= 24]
    return sorted(spans)


def made_text(rng):
    pieces = ["password", "Token", "API_key", "apikey", '"', "'", ": ", "=", " = ", " ", "\n", "é", "😀", "AKIA",
              "ABCDEF0123456789", "0123456789abcdef01234567", "abcdef", "x_y", "secret=", "passwd", "tokens", "a.b", "ſecret=abcdefg"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))


def spans(rows):
    return [[(s.start, s.kind, s.end) for s in r] for r in rows]


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(4)
    texts = [made_text(rng) for _ in range(600)] + [None, "", "password=token: abcdefgh", "token=secret=abc", "AKIA" * 9, "f" * 23, "f" * 24]
    data = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    none = S.SecretModel([0.0] * S._SYMBOLS**2, float("inf"))
    for row in S.find_secrets(data, none).collect():
        assert spans([row.base_spans])[0] == plain_base(row.text or "") and row.spans == row.base_spans


def plain_ratios(counts):
    after, alone, total = {}, {}, {True: 0, False: 0}
    for (label, a, b), n in counts.items():
        after[label, a] = after.get((label, a), 0) + n
        alone[label, b] = alone.get((label, b), 0) + n
        total[label] += n

    def p(label, a, b):
        anywhere = (alone.get((label, b), 0) + 1) / (total[label] + 68)
        return (counts.get((label, a, b), 0) + 8 * anywhere) / (after.get((label, a), 0) + 8)

    return lambda s: sum(math.log(p(True, a, b) / p(False, a, b)) for a, b in zip("\0" + s, s)) / len(s)


def counted(samples):
    counts = {}
    for token, label in samples:
        for a, b in zip("\0" + token, token):
            counts[label, a, b] = counts.get((label, a, b), 0) + 1
    return counts


def crossed(samples):
    halves = [[s for s in samples if zlib.crc32(s[0].encode()) % 2 == h] for h in (0, 1)]
    models = [plain_ratios(counted(h)) for h in reversed(halves)]
    return [(models[h](token), token, label) for h in (0, 1) for token, label in halves[h]]


def best_cut(scored, cost):
    bins = sorted({math.floor(s * 50) for s, _, _ in scored})
    best, at = 0.0, math.inf
    for low, high in zip(bins, bins[1:]):
        above = {label: [math.floor(s * 50) > low for s, _, x in scored if x == label] for label in (True, False)}
        gain = sum(above[True]) / len(above[True]) - cost * sum(above[False]) / len(above[False])
        if gain > best + 1e-12:
            best, at = gain, (low + 1 + high) / 100
    return at


def plain_model(samples):
    scored = crossed(samples)
    cut = best_cut(scored, 1)
    clean = [(token, label) for s, token, label in scored if label or s <= cut]
    return plain_ratios(counted(clean)), best_cut(crossed(clean), 10)


def test_model_and_spans_equal_plain_version(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["user", "account", "settings", "database", "connection", "manager", "update", "handler"]
    texts = []
    for i in range(200):
        said = ["_".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(6)]
        if i % 4 == 0:
            said.append("".join(rng.choices(letters, k=rng.randint(20, 50))))
        if i % 5 == 0:
            said.append("token = '" + "".join(rng.choices("0123456789abcdef", k=40)) + "'")
        texts.append(" ".join(said))
    data = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    samples = S.labelled_samples(data)
    pairs = [(r.token, r.random) for r in samples.collect()]
    bases = {t: plain_base(t) for t in texts}
    ordinary = []
    for t in texts:
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", t):
            if not any(s < m.end() and m.start() < e for s, _, e in bases[t]):
                ordinary.append(m.group())
    assert sorted(p for p, label in pairs if not label) == sorted(ordinary)
    model = S.train_secret_model(samples)
    score, threshold = plain_model(pairs)
    assert math.isclose(model.threshold, threshold, rel_tol=1e-9)
    found, right = S.find_secrets(data, model).collect(), 0
    for row in found:
        text = row.text or ""
        base = plain_base(text)
        extra = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            apart = not any(s < m.end() and m.start() < e for s, _, e in base)
            if apart and score(m.group()) > threshold:
                extra.append((m.start(), 3, m.end()))
        assert spans([row.base_spans, row.spans]) == [base, sorted(base + extra)]
        right += len(extra)
    assert right == 50


@pytest.mark.parametrize("token", ["a", "Zq" * 3000, "x" * S._PIECE, "y" * (S._PIECE + 1), "é" * 40 + "ab"])
def test_score_of_pieces_is_the_mean_of_all_pairs(spark, token):
    ratios = [math.sin(i) for i in range(S._SYMBOLS**2)]
    model = S.SecretModel(ratios, 0.0)
    got = spark.createDataFrame([(token,)], "t string").select(S._score(F.col("t"), model.column())).first()[0]
    if token.isascii():
        codes = [0, *token.encode()]
        assert math.isclose(got, sum(ratios[a * 128 + b] for a, b in zip(codes, codes[1:])) / len(token), rel_tol=1e-9)


def test_spans_that_touch_and_overlap(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        cut = sorted(rng.sample(range(60), 2 * rng.randint(0, 6)))
        candidates = [(a, b, "") for a, b in zip(cut[::2], cut[1::2])]
        base = sorted((s, rng.randint(0, 2), s + rng.randint(1, 20)) for s in rng.sample(range(60), rng.randint(0, 5)))
        rows.append((candidates, base))
    kinds = "candidates array<struct<start:int,end:int,g0:string>>, base array<struct<start:int,kind:int,end:int>>"
    for row in spark.createDataFrame(rows, kinds).withColumn("free", S._apart(F.col("candidates"), F.col("base"))).collect():
        free = [c for c in row.candidates if not any(b.start < c.end and c.start < b.end for b in row.base)]
        assert row.free == free


def test_long_texts_and_many_matches(spark):
    text = ("password=abcdef1 " + "word " * 3 + "0123456789abcdef01234567 ") * 20_000
    blob = "Ab3dEf9h" * 300_000
    data = spark.createDataFrame([(text, 1), (blob, 2), (None, 3)], "text string, spans int")
    model = S.SecretModel([1.0] * S._SYMBOLS**2, 0.5)
    found = S.find_secrets(data, model).select(
        F.size("base_spans").alias("base"), F.size("spans").alias("n"), F.get("spans", F.size("spans") - 1).alias("last")
    )
    long, one, none = sorted(found.collect(), key=lambda r: -r.n)
    assert (long.base, long.n, long.last.end) == (40_000, 40_000, len(text) - 1)
    assert (one.base, one.n, one.last.end, none.n) == (0, 1, len(blob), 0)


def test_samples_of_one_label_add_nothing(spark):
    samples = spark.createDataFrame([("abc", True), (None, False), ("", False), ("x", None)], "token string, random boolean")
    assert S.train_secret_model(samples).threshold == float("inf")
    assert S.train_secret_model(samples.limit(0)).threshold == float("inf")
    data = spark.createDataFrame([], "text string")
    assert S.find_secrets(data, S.train_secret_model(S.labelled_samples(data))).collect() == []


def test_query_is_native_and_reads_text_without_a_shuffle(spark):
    plan = REGISTRY["op12_secret_scan"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
