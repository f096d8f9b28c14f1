"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram is the product of its letters'
vectors, each rotated by its place; a text is the sum of its n-grams, and a language the
sum of its training texts.  A text has the language whose sum is nearest by cosine.

Texts become n-gram counts and one matrix product per batch of texts; the sums of the
languages are added up inside each task and then over tasks, as integers, so that they
do not depend on the order of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, text_of, with_results

UNDETERMINED = "und"
DIMS = 1024
GRAM = 3
# What a task works on at once: so many characters, texts, and entries of a table.
_BATCH_CHARS = 1 << 19
_BATCH_TEXTS = 1024
_TABLE = 1 << 20
# Languages that are learnt at most, the commonest first: bounds what driver and tasks hold.
MAX_LANGUAGES = 4096
_CODES = 0x110000
_BITS = np.uint64(21)


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_CODES)), bool, _CODES)


@lru_cache(4096)
def _letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def _gram_vectors(codes: np.ndarray, gram: int, dims: int, seed: int) -> np.ndarray:
    """One row per n-gram: its letters' vectors, rotated by place and multiplied."""
    result = np.ones((len(codes), dims), np.int8)
    for place in range(gram):
        letters = (codes >> (_BITS * np.uint64(place))) & np.uint64((1 << 21) - 1)
        distinct, at = np.unique(letters, return_inverse=True)
        vectors = np.stack([_letter_vector(int(c), dims, seed) for c in distinct])
        result *= np.roll(vectors, gram - 1 - place, axis=1)[at]
    return result.astype(np.float32)


@dataclass(frozen=True)
class Grams:
    """N-gram counts of some texts: for each entry its text, n-gram and count."""

    texts: int
    rows: np.ndarray
    at: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    letters: np.ndarray  # per text: has it any letter?

    def sums(self, dims: int, seed: int, gram: int) -> np.ndarray:
        """One vector per text, the sum of its n-grams; whole numbers."""
        total = np.zeros((self.texts, dims))
        order = np.argsort(self.at, kind="stable")
        sorted_at = self.at[order]
        step = max(64, min(_TABLE // max(1, self.texts), _TABLE // dims))
        for low in range(0, len(self.codes), step):
            codes = self.codes[low : low + step]
            a, b = np.searchsorted(sorted_at, (low, low + len(codes)))
            part = order[a:b]
            table = np.zeros((self.texts, len(codes)), np.float32)
            table[self.rows[part], self.at[part] - low] = self.counts[part]
            total += table @ _gram_vectors(codes, gram, dims, seed)
        return total


def _symbols(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, and 0 for every run of other characters that touches a letter, with the text of each.

    Also: has a text any letter?
    """
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _is_letter()[codes]
    has = np.bincount(rows[letter], minlength=len(lowered)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (rows[1:] == rows[:-1])
    keep[:-1] |= letter[1:] & (rows[1:] == rows[:-1]) & ~keep[:-1]
    symbols = np.where(letter, codes, 0)[keep].astype(np.uint64)
    rows = rows[keep]
    if len(symbols) >= 2:  # two blanks in a row stand between words set apart by more than one character
        double = np.zeros(len(symbols), bool)
        double[1:] = (symbols[1:] == 0) & (symbols[:-1] == 0) & (rows[1:] == rows[:-1])
        symbols, rows = symbols[~double], rows[~double]
    return symbols, rows, has


def _counted(symbols: np.ndarray, rows: np.ndarray, has: np.ndarray, gram: int) -> Grams:
    size = len(symbols) - gram + 1
    if size <= 0:
        none = np.zeros(0, np.int64)
        return Grams(len(has), none, none, none, np.zeros(0, np.uint64), has)
    packed = np.zeros(size, np.uint64)
    for place in range(gram):
        packed |= symbols[place : place + size] << (_BITS * np.uint64(place))
    inside = rows[:size] == rows[gram - 1 :]
    distinct, at = np.unique(packed[inside], return_inverse=True)
    width = max(1, len(distinct))
    pairs, counts = np.unique(rows[:size][inside] * width + at, return_counts=True)
    return Grams(len(has), pairs // width, pairs % width, counts, distinct, has)


def _grams(texts: list[str], gram: int) -> Grams:
    """N-grams of texts: letters are lower-cased, every run of other characters is one blank."""
    return _counted(*_symbols([f" {t.lower()} " for t in texts]), gram)


def _pieces(text: str, gram: int) -> Iterator[Grams]:
    """N-grams of one text of any length, a bounded piece at a time.

    A piece starts with the last character before it, which tells whether blanks run on, and
    its symbols follow on the last ones before it.
    """
    lowered = f" {text.lower()} "
    held = np.zeros(0, np.uint64)
    for start in range(0, len(lowered), _BATCH_CHARS):
        piece = lowered[max(0, start - 1) : start + _BATCH_CHARS]
        symbols, _, has = _symbols([piece])
        if start and piece[0].isalpha():
            symbols = symbols[1:]
        if len(held) and len(symbols) and held[-1] == 0 and symbols[0] == 0:
            symbols = symbols[1:]
        held = np.concatenate([held, symbols])
        yield _counted(held, np.zeros(len(held), np.int64), has, gram)
        held = held[max(0, len(held) - gram + 1) :]


def _sums_of(texts: list[str], gram: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One vector per text, and whether it has a letter."""
    if len(texts) != 1 or len(texts[0]) <= _BATCH_CHARS:
        grams = _grams(texts, gram)
        return grams.sums(dims, seed, gram), grams.letters
    total, letters = np.zeros((1, dims)), np.zeros(1, bool)
    for grams in _pieces(texts[0], gram):
        total += grams.sums(dims, seed, gram)
        letters |= grams.letters
    return total, letters


def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in batches of bounded size, with the index of the first; a null is empty."""
    first, size, held = 0, 0, []
    for index, text in enumerate(texts):
        text = text or ""
        if held and (size + len(text) > _BATCH_CHARS or len(held) == _BATCH_TEXTS):
            yield first, held
            first, size, held = index, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield first, held


@dataclass(frozen=True)
class Profiles:
    """Trained languages: names in order, and one vector each."""

    names: list[str]
    vectors: np.ndarray
    dims: int = DIMS
    gram: int = GRAM
    seed: int = 1

    def predict(
        self, texts: list[str | None], claimed: list[str | None] | None = None
    ) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and cosine (0 if negative) of each text, and its cosine with a claimed language.

        The last is NaN without a claim, for a language that was not learnt, and without letters.
        """
        names = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        claims = np.full(len(texts), np.nan)
        place = {n: i for i, n in enumerate(self.names)} if claimed else {}
        lengths = np.linalg.norm(self.vectors, axis=1)
        unit = self.vectors / np.where(lengths > 0, lengths, 1)[:, None]
        for first, part in _portions(texts):
            sums, letters = _sums_of(part, self.gram, self.dims, self.seed)
            norms = np.linalg.norm(sums, axis=1)
            cosines = (sums @ unit.T) / np.where(norms > 0, norms, 1)[:, None]
            for i in np.flatnonzero(letters) if self.names else ():
                best = int(np.argmax(cosines[i]))
                names[first + i] = self.names[best]
                scores[first + i] = min(1.0, max(0.0, float(cosines[i, best])))
                if claimed and claimed[first + i] in place:
                    claims[first + i] = max(0.0, float(cosines[i, place[claimed[first + i]]]))
        return names, scores, claims


def _added_up(rows: Iterator[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    total: dict[str, np.ndarray] = {}
    for name, vector in rows:
        total[name] = total[name] + vector if name in total else vector
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.string()),
            pa.array([v.tobytes() for v in total.values()], pa.binary()),
        ],
        names=["name", "vector"],
    )


def train_profiles(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    dims: int = DIMS,
    gram: int = GRAM,
    seed: int = 1,
    fan_in: int = 32,
    max_languages: int = MAX_LANGUAGES,
) -> Profiles:
    """Profiles of the languages named in `docs`; rows with a null text or language are left out.

    Each task sends one vector per language; these are added up in `fan_in` tasks before
    the driver sees them.  Of more than `max_languages` names, the commonest are learnt
    (ties: the first by name): a column of names that are none bounds no memory otherwise.
    """
    some = docs.select(column(text_col).alias("text"), column(lang_col).alias("name"))
    some = some.filter("text is not null and name is not null")
    counted = some.groupBy("name").count().orderBy(F.desc("count"), "name").limit(max_languages + 1)
    known = [r["name"] for r in counted.collect()]
    if len(known) > max_languages:
        some = some.join(F.broadcast(docs.sparkSession.createDataFrame([(n,) for n in known[:-1]], "name string")), "name")
        some = some.select("text", "name")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors() -> Iterator[tuple[str, np.ndarray]]:
            for batch in batches:
                names = batch.column(1).to_pylist()
                for first, part in _portions(batch.column(0).to_pylist()):
                    here = names[first : first + len(part)]
                    if len(part) == 1:
                        sums, _ = _sums_of(part, gram, dims, seed)
                        yield here[0], np.rint(sums[0]).astype(np.int64)
                        continue
                    distinct = sorted(set(here))
                    index = {n: i for i, n in enumerate(distinct)}
                    grams = _grams(part, gram)
                    by_name = np.array([index[n] for n in here])
                    # Texts of one language are one text: one entry per language and n-gram.
                    width = max(1, len(grams.codes))
                    pairs, at = np.unique(by_name[grams.rows] * width + grams.at, return_inverse=True)
                    counts = np.bincount(at, grams.counts, len(pairs))
                    merged = Grams(
                        len(distinct), pairs // width, pairs % width, counts, grams.codes, grams.letters
                    )
                    sums = np.rint(merged.sums(dims, seed, gram)).astype(np.int64)
                    yield from zip(distinct, sums)

        yield _added_up(vectors())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added_up(
            (n, np.frombuffer(v, np.int64))
            for b in batches
            for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        )

    ddl = "name string, vector binary"
    parts = some.mapInArrow(bundle, ddl).repartition(fan_in).mapInArrow(add_up, ddl).collect()
    total: dict[str, np.ndarray] = {}
    for row in parts:
        vector = np.frombuffer(row["vector"], np.int64)
        total[row["name"]] = total[row["name"]] + vector if row["name"] in total else vector
    names = sorted(total)
    vectors = np.stack([total[n] for n in names]) if names else np.zeros((0, dims), np.int64)
    return Profiles(names, vectors.astype(np.float64), dims, gram, seed)


def identify_language(
    docs: DataFrame, profiles: Profiles, text_col: str = "text", claimed_col: str | None = None
) -> DataFrame:
    """Documents with `lang_pred` and `score` (cosine with that language, 0 to 1).

    `lang_pred` is `und`, with score 0, if the text is null or has no letter, or if no
    language was trained.  Equal cosines go to the first language by name.  With
    `claimed_col`, also `claimed_score`: the cosine with the language that the row names, null
    if it names none that was trained.  Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        said = text_of(batch, claimed_col).to_pylist() if claimed_col else None
        names, scores, claims = shared.value.predict(text_of(batch, text_col).to_pylist(), said)
        found = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}
        return found | {"claimed_score": pa.array(claims, from_pandas=True)} if claimed_col else found

    added = "lang_pred string, score double"
    return with_results(docs, f"{added}, claimed_score double" if claimed_col else added, make)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Is the CRC-32 of the id, as text, this remainder?  A null id is not held out."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
