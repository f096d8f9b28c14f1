"""Porter (1980) stemming of token arrays.

The stemmer is a small pure function.  Spark ships token arrays to it as Arrow
batches; each batch is dictionary-encoded first, so it runs once per distinct
token of a batch, and not once per occurrence.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanmill.functions.lookup import in_portions

# [C](VC)^m[V]: `y` is a vowel after a consonant.
_VOWEL = "[aeiouy]"
_CRUN = "[^aeiou][^aeiouy]*"
_VRUN = "[aeiouy][aeiou]*"

_M_GT_0 = re.compile(f"^(?:{_CRUN})?{_VRUN}{_CRUN}")
_M_EQ_1 = re.compile(f"^(?:{_CRUN})?{_VRUN}{_CRUN}(?:{_VRUN})?$")
_M_GT_1 = re.compile(f"^(?:{_CRUN})?{_VRUN}{_CRUN}{_VRUN}{_CRUN}")
_HAS_VOWEL = re.compile(f"^(?:{_CRUN})?{_VOWEL}")
_ENDS_CVC = re.compile(f"^{_CRUN}{_VOWEL}[^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")

# Suffix tables of the published algorithm (with its author's later
# `bli` and `logi` rules).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = frozenset(
    "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
)


def _longest(word: str, suffixes, lengths: range) -> str | None:
    """Longest listed suffix of a word, trying lengths from long to short."""
    for n in lengths:
        if word[-n:] in suffixes:
            return word[-n:]
    return None


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str) -> str:
    """Stem one lower-case token; tokens of up to two characters stay."""
    if len(word) < 3:
        return word
    # 1a plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b past and progressive forms
    if word.endswith("eed"):
        if _M_GT_0.match(word[:-3]):
            word = word[:-1]
    else:
        stem = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if stem is not None and _HAS_VOWEL.match(stem):
            if stem.endswith(("at", "bl", "iz")):
                word = stem + "e"
            elif _DOUBLE.search(stem):
                word = stem[:-1]
            elif _ENDS_CVC.match(stem):
                word = stem + "e"
            else:
                word = stem
    # 1c
    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    # 2 and 3 derivational suffixes
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table, range(7, 2, -1))
        if suffix and _M_GT_0.match(word[: -len(suffix)]):
            word = word[: -len(suffix)] + table[suffix]
    # 4: `ion` falls only after s or t
    suffix = _longest(word, STEP_4, range(5, 1, -1))
    if suffix:
        cut = 3 if suffix in ("sion", "tion") else len(suffix)
        if _M_GT_1.match(word[:-cut]):
            word = word[:-cut]
    # 5 final e and double l
    if word.endswith("e"):
        stem = word[:-1]
        if _M_GT_1.match(stem) or (_M_EQ_1.match(stem) and not _ENDS_CVC.match(stem)):
            word = stem
    if word.endswith("ll") and _M_GT_1.match(word):
        word = word[:-1]
    return word


def stem_lists(tokens: pa.Array) -> pa.Array:
    """Stem a list<string> Arrow array, once per distinct token."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    flat = tokens.flatten()
    coded = flat.dictionary_encode()
    stems = pa.array([porter_stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    values = stems.take(coded.indices)
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(
        offsets, values, mask=tokens.is_null() if tokens.null_count else None
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    return in_portions(tokens, stem_lists)
