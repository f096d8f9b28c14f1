"""Vector codes against all distances, and against a plain version of the whole operator."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from scanmill.llm import frames
from scanmill.llm.vector_codes import encode_vectors, nearest_entries


@pytest.mark.parametrize("size", [1, 5, 1 << 20, 1 << 38])
def test_search_equals_all_distances(size):
    rng = np.random.Generator(np.random.PCG64(size % 97))
    for _ in range(40):
        d, k = int(rng.integers(1, 9)), int(rng.integers(1, 17))
        parts = rng.integers(-size, size + 1, (50, d))
        book = rng.integers(-size, size + 1, (k, d))
        number, best = nearest_entries(parts, book)
        for part, n, b in zip(parts.tolist(), number, best):
            all_ = [sum((x - y) ** 2 for x, y in zip(part, entry)) for entry in book.tolist()]
            assert int(b) == min(all_) and n == all_.index(min(all_))


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error) of rows (id, vector of equal lengths), step by step."""
    vectors = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    width = -(-len(vectors[0][1]) // parts)
    cut = [(i, [(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)]) for i, v in vectors]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][p]) for r in first] for p in range(parts)]

    def nearest(part, book):
        away = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        new = [[list(e) for e in book] for book in books]
        for p in range(parts):
            groups = {}
            for _, v in cut:
                groups.setdefault(nearest(v[p], books[p])[0], []).append(v[p])
            for e, held in groups.items():
                new[p][e] = [sum(c) // len(held) for c in zip(*held)]
        books = new
    result = []
    for i, v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        result.append((i, "".join(f"{n:02x}" for n, _ in found), sum(d for _, d in found)))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return result, digest


@pytest.mark.parametrize("dims,n", [(16, 60), (5, 40), (8, 3), (24, 1)])
def test_operator_equals_plain_version(spark, dims, n):
    rng = np.random.Generator(np.random.PCG64(dims))
    rows = [(int(i // 2), rng.normal(size=dims).astype(np.float32).tolist()) for i in rng.permutation(n)]
    rows += [(None, rows[0][1]), (rows[0][0], rows[0][1])]
    data = spark.createDataFrame([(i, v, (i or 0) % 3) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = encode_vectors(data).collect()
    expected, digest = plain(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == sorted(expected, key=repr)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1] * 8, "a", "x"), (2, [0.2] * 8, None, "y"), (2, [0.2] * 8, None, "y"), (3, None, "a", "z"),
        (4, [nan] + [0.0] * 7, "a", "z"), (5, [inf] * 8, "a", "z"), (6, [None] + [0.0] * 7, "a", "z"),
        (7, [], "a", "short"), (8, [1.0] * 3, None, "short"), (9, [1e300] * 8, "b", "huge"), (10, [1e8] * 8, "b", "big"),
    ]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code string")
    got = {r.vec_id: r for r in encode_vectors(data).collect()}
    assert set(got) == {1, 2, 7, 8, 9, 10}
    assert encode_vectors(data).filter("vec_id = 2").count() == 2
    assert got[1].code == "00" * 8 and got[2].code in ("01" * 8, "02" * 8) and got[10].code == "03" * 8
    assert [got[i].code for i in (7, 8, 9)] == [None] * 3 and [got[i].error for i in (1, 2, 10)] == [0, 0, 0]
    assert got[7].label_error == 0 and got[9].label_error == 0 and got[8].label_error == 0
    empty = encode_vectors(data.limit(0))
    assert empty.collect() == [] and "label_error" in empty.columns
    assert encode_vectors(data.filter("vec_id = 3 or vec_id = 7")).first().code is None


def test_large_group_tables_split_hot_groups(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"g{i}") for i in range(600)]
    data = spark.createDataFrame(rows, "id int, g string")
    values = data.groupBy("g").agg({"id": "sum", "*": "count"}).toDF("g", "n", "total").select("g", "total", "n")
    whole = sorted(map(repr, frames.with_group_values(data, "g", values, "n").collect()))
    monkeypatch.setattr(frames, "_SMALL_BYTES", 1)
    monkeypatch.setattr(frames, "_HOT_SHARE", 10)
    split = frames.with_group_values(data, "g", values, "n")
    assert sorted(map(repr, split.collect())) == whole and len(whole) == 600
