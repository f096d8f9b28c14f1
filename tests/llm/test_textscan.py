from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scanmill.llm import textscan
from scanmill.llm.textscan import ALPHANUMERIC, LOWER, NOT_SPACE, SAME, blocks, windows, within_row, words_of

CASES = [
    (NOT_SPACE, SAME, r"[^\x20\x09-\x0D]+"),
    (ALPHANUMERIC, LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
]
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é\t\n |,ü\x00\x85", max_size=40)), max_size=12)


def fold(text, lower):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower is LOWER else text


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 64))
def test_words_are_those_of_the_pattern(texts, limit):
    for kind, lower, pattern in CASES:
        seen = 0
        for block in blocks(pa.array(texts, pa.string()), limit):
            words = words_of(block, kind, lower)
            for row in range(block.rows):
                span = slice(words.first[row], words.first[row + 1])
                found = [
                    lower[block.data[s:e]].tobytes().decode()
                    for s, e in zip(words.starts[span], words.ends[span])
                ]
                assert found == re.findall(pattern, fold(texts[block.first + row] or "", lower))
                assert (words.rows[span] == row).all()
            seen += block.rows
        assert seen == len(texts)


def test_hashes_tell_words_and_windows_apart():
    block = next(blocks(pa.array(["a b ab a b c ab a b", "ba a b", "", "b"])))
    words = words_of(block, NOT_SPACE)
    said = ["a", "b", "ab", "a", "b", "c", "ab", "a", "b", "ba", "a", "b", "b"]
    assert len(set(words.hashes.tolist())) == len(set(said))
    for length in (1, 2, 3, 7):
        found = windows(words.hashes, length)
        runs = [tuple(said[i : i + length]) for i in range(len(said) - length + 1)]
        assert len(found) == len(runs)
        pairs = set(zip(runs, found.tolist()))
        assert len(pairs) == len(set(runs)) == len(set(found.tolist()))
    assert len(windows(words.hashes[:2], 3)) == 0
    assert within_row(words.rows, 3).tolist() == [True] * 7 + [False, False, True, False]


def test_a_word_longer_than_a_piece_and_a_sliced_column():
    long = "x" * 1_500_000
    column = pa.array(["skip", f"a {long} b", long, None])[1:]
    words = [words_of(b, NOT_SPACE) for b in blocks(column)]
    hashes = np.concatenate([w.hashes for w in words])
    assert len(hashes) == 4 and hashes[1] == hashes[3]


def test_pieces_do_not_change_the_hashes(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab É\n.X 12") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["x" * 500, "y" * 256 + " " + "z" * 255, "", "long" * 90 + " end"]
    (block,) = textscan.blocks(pa.array(texts))
    whole = textscan.words_of(block, textscan.NOT_SPACE, textscan.LOWER)
    for size in (1, 7, 64, 255):
        monkeypatch.setattr(textscan, "_PIECE_BYTES", size)
        found = textscan.words_of(block, textscan.NOT_SPACE, textscan.LOWER)
        assert (found.hashes == whole.hashes).all() and (found.starts == whole.starts).all()


def test_a_long_word_takes_bounded_memory():
    (block,) = textscan.blocks(pa.array(["w" * (16 << 20)]))
    tracemalloc.start()
    words = textscan.words_of(block, textscan.NOT_SPACE)
    assert len(words.hashes) == 1 and tracemalloc.get_traced_memory()[1] < 128 << 20
    tracemalloc.stop()
