"""Benchmark decontamination: find passages of test items in training documents.

The hashes of all 13-word windows of the items are broadcast; tasks slide over the
words of each document, look the hashes up, compare the words of every hit, and mark
or remove what is covered.  Documents are never shuffled.

Benchmarks are small beside a corpus, but this is checked: items are cut into groups
whose tables of windows take at most `max_broadcast_bytes`, and each group is one more
pass over the documents' rows, so that a larger benchmark costs time and not memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, others, text_of, with_results
from scanmill.llm.textscan import ALPHANUMERIC, LOWER, Block, Words, blocks, windows, words_of
from scanmill.runtime import written

WINDOW = 13
MAX_BROADCAST_BYTES = 192 << 20
# Of a table, for each word: 8 for its place, 16 for a window's hash, example and items, 4 for
# each item that has it.
TABLE_BYTES = 28
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FILTER_BITS = 22
_SPANS = "array<struct<start:bigint,end:bigint>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _folded(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, folded, each followed by one blank: bytes, starts and ends of words."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    said = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(said), bool)
    inside[ends] = False
    said[inside] = LOWER[block.data[np.repeat(words.starts - starts, sizes) + np.flatnonzero(inside)]]
    return said, starts, ends


@dataclass(frozen=True)
class _Table:
    """Distinct windows of one length, by hash; those of different words may share one."""

    hashes: np.ndarray
    words: np.ndarray  # where in the items' words an example begins
    first: np.ndarray  # where its items begin; one entry more than windows
    items: np.ndarray
    filter: np.ndarray

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose hash is in the table."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        return maybe[self.hashes[at] == hashes[maybe]]


class Windows:
    """The windows of some items: their words once, and about 28 bytes a window (TABLE_BYTES)."""

    def __init__(self, ids: list, texts: list[str], window: int) -> None:
        self.ids = ids
        said, starts, ends = [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = count = 0
        for block in blocks(pa.array(texts, pa.string())):
            words = words_of(block, ALPHANUMERIC, LOWER)
            text, start, end = _folded(block, words)
            said.append(text)
            starts.append(start + size)
            ends.append(end + size)
            for row in range(block.rows):
                first, last = int(words.first[row]), int(words.first[row + 1])
                length = min(window, last - first)
                if length:
                    hashes = windows(words.hashes[first:last], length)
                    places = np.arange(first, first + len(hashes)) + count
                    item = np.full(len(hashes), block.first + row)
                    found.setdefault(length, []).append((hashes, places, item))
            size += len(text)
            count += len(start)
        none = np.zeros(0, np.int64)
        self._said = np.concatenate(said) if said else np.zeros(0, np.uint8)
        self._starts = np.concatenate(starts or [none]).astype(np.uint32)
        self._ends = np.concatenate(ends or [none]).astype(np.uint32)
        self.by_length = {n: self._table(n, *map(np.concatenate, zip(*parts))) for n, parts in found.items()}

    def words_at(self, place: int, length: int) -> bytes:
        return self._said[self._starts[place] : self._ends[place + length - 1]].tobytes()

    def _table(self, length: int, hashes: np.ndarray, places: np.ndarray, items: np.ndarray) -> _Table:
        order = np.lexsort((items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        # Windows that share a hash are told apart by their words, so by a second number.
        second = np.zeros(len(hashes), np.int64)
        bounds = np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes))
        for run in np.flatnonzero(np.diff(bounds) > 1):
            numbers: dict[bytes, int] = {}
            for i in range(bounds[run], bounds[run + 1]):
                second[i] = numbers.setdefault(self.words_at(int(places[i]), length), len(numbers))
        order = np.lexsort((items, second, hashes))
        hashes, places, items, second = hashes[order], places[order], items[order], second[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1]))
        kept = new | np.append(True, items[1:] != items[:-1])
        first = np.append(np.cumsum(kept)[new] - 1, kept.sum())
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return _Table(
            hashes[new], places[new].astype(np.uint32), first.astype(np.uint32), items[kept].astype(np.uint32), bits
        )

    def items_of(self, length: int, value: np.uint64, said: bytes) -> np.ndarray:
        """The items that hold a window of these words."""
        table = self.by_length[length]
        at = int(np.searchsorted(table.hashes, value))
        while at < len(table.hashes) and table.hashes[at] == value:
            if self.words_at(int(table.words[at]), length) == said:
                return table.items[table.first[at] : table.first[at + 1]]
            at += 1
        return np.zeros(0, np.uint32)


def _hits(block: Block, words: Words, found: Windows) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, first word, words, items) of each occurrence of a window in a block."""
    for length, table in found.by_length.items():
        hashes = windows(words.hashes, length)
        maybe = table.candidates(hashes)
        maybe = maybe[words.rows[maybe] == words.rows[maybe + length - 1]]
        if not len(maybe):
            continue
        said, starts, ends = _folded(block, words)
        for at in maybe.tolist():
            items = found.items_of(length, hashes[at], said[starts[at] : ends[at + length - 1]].tobytes())
            if len(items):
                yield int(words.rows[at]), at, length, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap as one."""
    result: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if result and start <= result[-1][1]:
            result[-1] = (result[-1][0], max(result[-1][1], end))
        else:
            result.append((start, end))
    return result


def _groups(items: DataFrame, max_bytes: int) -> int:
    """How many groups the items need so that the table of each takes about `max_bytes` at most."""
    words = F.regexp_count("text", F.lit(_WORD))
    size = items.agg(F.sum(F.octet_length("text") + (words + 1) * F.lit(TABLE_BYTES))).first()[0] or 0
    # Groups are made by a hash, so they are planned half as large as they may be.
    return 1 if size <= max_bytes else -(-2 * int(size) // max_bytes)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "item_id",
    text_col: str = "text",
    benchmark_text_col: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Documents with `n_words`, `n_hit`, `hit_spans` (word ranges) and `hit_items`.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased.  A window is `window` consecutive words of an item; an item with fewer
    words is one window.  A word of a document is hit if it lies in any occurrence of a
    window.  `hit_items` are the ids, as sorted strings, of the items found.

    Items without an id, text or word take no part; items that share an id are one item.
    A null text has no words.  Input columns with the names of new ones are replaced.
    """
    items = benchmark.select(
        column(id_col).cast("string").alias("id"), column(benchmark_text_col).alias("text")
    ).filter("id is not null and text is not null")
    spark = docs.sparkSession
    groups = _groups(items, max_broadcast_bytes)
    added = f"n_words bigint, n_hit bigint, hit_spans {_SPANS}, hit_items array<string>"
    result = docs.select(*(column(c) for c in others(docs, "n_words", "n_hit", "hit_spans", "hit_items")))
    for group in range(groups):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == group)
        rows = part.collect()
        shared = spark.sparkContext.broadcast(
            Windows([r["id"] for r in rows], [r["text"] for r in rows], window)
        )
        result = _pass(result, shared, text_col, added, more=group > 0)
        if group < groups - 1:
            # Passes one after another: a task never holds the tables of two.
            result = written(result, "contamination")
    return result


def _pass(docs: DataFrame, shared, text_col: str, added: str, more: bool) -> DataFrame:
    """Mark what one group of items hits, on top of what earlier groups have hit."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = batch.num_rows
        spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        items: list[set[str]] = [set() for _ in range(rows)]
        if more:
            for row, (old, ids) in enumerate(
                zip(text_of(batch, "hit_spans").to_pylist(), text_of(batch, "hit_items").to_pylist())
            ):
                spans[row] = [(s["start"], s["end"]) for s in old]
                items[row] = set(ids)
        counts = np.zeros(rows, np.int64)
        for block in blocks(text_of(batch, text_col)):
            words = words_of(block, ALPHANUMERIC, LOWER)
            counts[block.first : block.first + block.rows] = words.counts()
            for row, at, length, ids in _hits(block, words, shared.value):
                start = at - int(words.first[row])
                spans[block.first + row].append((start, start + length))
                items[block.first + row].update(shared.value.ids[i] for i in ids)
        spans = [_merged(s) for s in spans]
        return {
            "n_words": pa.array(counts),
            "n_hit": pa.array([sum(e - s for s, e in m) for m in spans], pa.int64()),
            "hit_spans": pa.array(
                [[{"start": s, "end": e} for s, e in m] for m in spans], pa.list_(_SPAN)
            ),
            "hit_items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        }

    return with_results(docs, added, make)


def contaminated(parts: int = 20):
    """Condition: at least one word in `parts` is hit."""
    return (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))


def remove_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the hit words out of the texts of `find_contamination`'s result.

    A span goes from the start of its first word to the end of its last one.  The
    columns that mark hits are left out.  A null text stays null.
    """
    marks = ("n_words", "n_hit", "hit_spans", "hit_items")

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = text_of(batch, text_col).to_pylist()
        spans = text_of(batch, "hit_spans")
        for block in blocks(text_of(batch, text_col)):
            words = None
            for row in range(block.rows):
                cut = spans[block.first + row].as_py()
                if not cut:
                    continue
                words = words or words_of(block, ALPHANUMERIC, LOWER)
                data = block.data[block.offsets[row] : block.offsets[row + 1]].tobytes()
                base, first = block.offsets[row], words.first[row]
                kept, at = [], 0
                for span in cut:
                    kept.append(data[at : words.starts[first + span["start"]] - base])
                    at = words.ends[first + span["end"] - 1] - base
                kept.append(data[at:])
                texts[block.first + row] = b"".join(kept).decode()
        return {text_col: pa.array(texts, pa.string())}

    result = with_results(marked, f"`{text_col}` string", make, drop=marks)
    return result.select(*(column(c) for c in others(marked, *marks)))


def items_digest(items: str = "hit_items"):
    """SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


__all__ = ["contaminated", "find_contamination", "items_digest", "remove_spans"]
