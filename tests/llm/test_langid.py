from __future__ import annotations

import numpy as np

from scanmill.llm import langid
from scanmill.llm.langid import _gram_vectors, _grams, _letter_vector, identify_language, train_profiles

EN = "the quick brown fox jumps over the lazy dog and the cat that sat with them"
DE = "der schnelle braune fuchs springt über den faulen hund und die katze saß"


def test_sums_equal_the_definition():
    text = "Áb1 c--ab"
    symbols = [0, ord("á"), ord("b"), 0, ord("c"), 0, ord("a"), ord("b"), 0]
    vector = lambda c: _letter_vector(c, 64, 3).astype(int)
    expected = sum(
        np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:])
    )
    grams = _grams(["", text, "12"], 3)
    sums = grams.sums(64, 3, 3)
    assert (sums[1] == expected).all() and not sums[0].any()
    assert grams.letters.tolist() == [False, True, False]
    assert set(np.unique(_gram_vectors(grams.codes, 3, 64, 3))) <= {-1.0, 1.0}


def test_prediction_and_odd_rows(spark):
    rows = [(EN, "en", 1), (DE, "de", 2), (None, "en", 3), ("unlabelled", None, 4)]
    train = spark.createDataFrame(rows, "text string, lang string, score int")
    profiles = train_profiles(train)
    assert profiles.names == ["de", "en"]
    asked = [("the dog and the fox", "de"), ("und der hund", None), (None, "en"), ("", ""), ("12 345!", ""), (EN * 2000, "")]
    docs = spark.createDataFrame(asked, "text string, score string")
    found = identify_language(docs, profiles)
    assert found.columns == ["text", "lang_pred", "score"]
    got = {r.text: (r.lang_pred, r.score) for r in found.collect()}
    assert got["the dog and the fox"][0] == "en" and got["und der hund"][0] == "de"
    assert got[None] == got[""] == got["12 345!"] == ("und", 0.0)
    assert got[EN * 2000][0] == "en" and 0.9 < got[EN * 2000][1] <= 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    profiles = train_profiles(empty)
    found = identify_language(spark.createDataFrame([("words",)], "text string"), profiles).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    assert identify_language(empty, profiles).collect() == []


def test_pieces_of_a_long_text_give_the_sums_of_the_whole(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(60):
        text = "".join(rng.choice(list("abΣß İ.,12"), int(rng.integers(5, 60))))
        whole = _grams([text], 3).sums(64, 1, 3)
        monkeypatch.setattr(langid, "_BATCH_CHARS", int(rng.integers(1, 12)))
        sums, letters = langid._sums_of([text], 3, 64, 1)
        assert (sums == whole).all() and bool(letters[0]) == any(c.isalpha() for c in text.lower())
        monkeypatch.undo()


def test_memory_is_bounded_by_the_piece(monkeypatch):
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(6))
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 400_000)))
    profiles = langid.Profiles(["x"], np.ones((1, 1024)))
    monkeypatch.setattr(langid, "_BATCH_CHARS", 1 << 16)
    tracemalloc.start()
    profiles.predict([text] + ["ab cd"] * 3000)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_claimed_languages_and_the_bound_of_languages(spark):
    rows = [(EN, "en"), (EN, "en"), (DE, "de"), (DE, "de"), ("xyz", "aa")]
    train = spark.createDataFrame(rows, "text string, lang string")
    profiles = train_profiles(train, max_languages=2)
    assert profiles.names == ["de", "en"]
    asked = [("the dog and the fox", "de"), ("the dog and the fox", "en"), ("the dog", None), ("the dog", "aa"), (None, "en")]
    found = identify_language(spark.createDataFrame(asked, "text string, lang string"), profiles, claimed_col="lang")
    got = [(r.lang_pred, r.claimed_score) for r in found.collect()]
    assert [g[0] for g in got] == ["en", "en", "en", "en", "und"]
    assert got[1][1] > 2 * got[0][1] >= 0 and [g[1] for g in got[2:]] == [None] * 3
