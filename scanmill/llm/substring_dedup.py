"""Substring dedup: remove passages that already start earlier in the corpus.

A window is a run of `window` consecutive words.  Its anchor is the smallest hash of its
runs of `_ANCHOR` words; equal windows have equal anchors, and neighbouring windows mostly
share theirs, so a document falls into units (stretches of windows with one anchor).  A
unit whose anchor occurs nowhere else is left alone.  The others are dealt by anchor into
shards of bounded size.

Each shard is an FM-index of its units, as sequences of symbols that stand for `_SYMBOL`
words.  The windows of the units are streamed through it by backward search; their
matching statistics tell which occur at least twice, and the suffix range of those gives
the first place in the corpus.  What is not at its first place is removed.

Units of one task that are equal are sent once, and an anchor with more than `HOT` units
is split by whole windows, so no passage fills a shard, however many documents hold it.
Documents with equal words are settled before, by a hash of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.llm.fm_index import FMIndex
from scanmill.llm.frames import column, others, split_join, text_of, with_results
from scanmill.llm.textscan import NOT_SPACE, blocks, windows, within_row, words_of
from scanmill.runtime import written

WINDOW = 20
HOT = 2000
SHARD_SYMBOLS = 1 << 20
BROADCAST_ROWS = 400_000
# Anchors of more than this share of all units are broadcast to them.
_COMMON_SHARE = 1000
_ANCHOR = 6
_SYMBOL = 5
_MAX_UNIT = 64  # windows in a unit
_SHARES = 128  # a place and a count of windows in one number: place * _SHARES + count
_MARK = "rid bigint, doc {kind}, start bigint, end bigint"


def _rid(id_col: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(id_col, text)


def _sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of `size` values, by doubling."""
    result, width = values, 1
    while width * 2 <= size:
        result = np.minimum(result[:-width], result[width:])
        width *= 2
    rest = size - width
    return np.minimum(result[: len(result) - rest], result[rest:]) if rest else result


def _units(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, first window, windows) of the units of a block of texts."""
    inside = within_row(words.rows, window)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    runs = windows(words.hashes, _ANCHOR)
    anchors = _sliding_minimum(runs, window - _ANCHOR + 1)
    rows = words.rows[: len(anchors)]
    # A unit has one place of one anchor: it ends where the anchor's first place is left behind.
    begins = np.ones(len(anchors), bool)
    begins[1:] = (runs[: len(anchors) - 1] == anchors[:-1]) | (anchors[1:] != anchors[:-1])
    begins[1:] |= (rows[1:] != rows[:-1]) | ~inside[:-1]
    begins &= inside
    starts = np.flatnonzero(begins)
    # A unit ends before the next one, or where its row has no more windows.
    next_ = np.concatenate([starts[1:], [len(anchors)]])
    last_of_row = words.first[rows[starts] + 1] - window + 1
    counts = np.minimum(next_, last_of_row) - starts
    parts = -(-counts // _MAX_UNIT)
    at = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    places = starts[at] + nth * _MAX_UNIT
    sizes = np.minimum(counts[at] - nth * _MAX_UNIT, _MAX_UNIT)
    return anchors[places], rows[places], places - words.first[rows[places]], sizes


def _described(rows: DataFrame, kind: str) -> DataFrame:
    """(doc, rid, n_words, same): `same` is a hash of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, same = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for block in blocks(batch.column(2)):
                words = words_of(block, NOT_SPACE)
                for row in range(block.rows):
                    own = words.hashes[words.first[row] : words.first[row + 1]]
                    counts[block.first + row] = len(own)
                    same[block.first + row] = xxhash.xxh3_128_digest(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(same, pa.binary())],
                names=["doc", "rid", "n_words", "same"],
            )

    return rows.mapInArrow(run, f"doc {kind}, rid bigint, n_words bigint, same binary")


def _postings(live: DataFrame, window: int) -> DataFrame:
    """(anchor, rid, place): the units of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for block in blocks(batch.column(2)):
                anchors, rows, first, counts = _units(words_of(block, NOT_SPACE), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors.view(np.int64)),
                        pa.array(ids[block.first + rows]),
                        pa.array(first * _SHARES + counts),
                    ],
                    names=["anchor", "rid", "place"],
                )

    return live.mapInArrow(run, "anchor bigint, rid bigint, place bigint")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """(doc, rid, packed): texts compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [
                pack.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                names=["doc", "rid", "packed"],
            )

    return rows.mapInArrow(run, f"doc {kind}, rid bigint, packed binary")


def _unpacked(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(p.as_buffer()) for p in packed], pa.binary())


def _sent_units(joined: DataFrame, kind: str, window: int, shards: int) -> DataFrame:
    """Units for the shards, and marks for those that a task has met before.

    (shard, doc, rid, first, whole, symbols): a unit of windows from word `first`, as the
    hashes of its runs of `_SYMBOL` words, or for a single window (`whole`) only those
    that make it up.  Rows without a shard are marks: `first` to `whole` are removed words.
    Equal units of a batch of rows are sent once, for the smallest (doc, first).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rids = batch.column(0), batch.column(1).to_numpy()
            order = _ranks(docs)
            texts, units = _unpacked(batch.column(2)), batch.column(3)
            best: dict[bytes, tuple] = {}
            marks: list[tuple] = []

            def offer(row: int, first: int, count: int, whole: bool, anchor: int, data: bytes) -> None:
                key = data + (b"w" if whole else b"u")
                mine = (order[row], first, row, count, whole, anchor, data)
                old = best.get(key)
                if old is None:
                    best[key] = mine
                    return
                kept, lost = (mine, old) if mine[:2] < old[:2] else (old, mine)
                best[key] = kept
                # Another row with the same id at the same place is not earlier.
                if kept[:2] != lost[:2]:
                    marks.append((lost[2], lost[1], lost[1] + lost[3] + window - 1))

            for block in blocks(texts):
                words = words_of(block, NOT_SPACE)
                symbols = windows(words.hashes, _SYMBOL)
                whole_hash = windows(words.hashes, window)
                for row in range(block.rows):
                    base = int(words.first[row])
                    listed = units[block.first + row].values
                    anchors = listed.field("anchor").to_numpy()
                    places = listed.field("place").to_numpy()
                    hot = listed.field("hot").to_numpy(zero_copy_only=False)
                    for anchor, place, is_hot in zip(anchors.tolist(), places.tolist(), hot.tolist()):
                        first, count = divmod(place, _SHARES)
                        at = base + first
                        if not is_hot:
                            data = symbols[at : at + count + window - _SYMBOL].tobytes()
                            offer(block.first + row, first, count, False, anchor, data)
                            continue
                        for i in range(count):
                            data = symbols[at + i : at + i + window : _SYMBOL][: window // _SYMBOL]
                            key = int(whole_hash[at + i].view(np.int64))
                            offer(block.first + row, first + i, 1, True, key, data.tobytes())
            yield _unit_rows(docs, rids, list(best.values()), marks, shards)

    return joined.mapInArrow(run, f"shard bigint, {_UNIT.format(kind=kind)}")


_UNIT = "doc {kind}, rid bigint, first bigint, end bigint, whole boolean, symbols binary"


def _ranks(values: pa.Array) -> list[int]:
    """The order of ids, as numbers."""
    distinct = sorted(set(values.to_pylist()))
    place = {v: i for i, v in enumerate(distinct)}
    return [place[v] for v in values.to_pylist()]


def _unit_rows(docs, rids, units: list[tuple], marks: list[tuple], shards: int) -> pa.RecordBatch:
    rows = [u[2] for u in units] + [m[0] for m in marks]
    gone = len(marks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([u[5] % shards for u in units] + [None] * gone, pa.int64()),
            docs.take(pa.array(rows, pa.int64())),
            pa.array(rids[rows] if rows else np.zeros(0, np.int64)),
            pa.array([u[1] for u in units] + [m[1] for m in marks], pa.int64()),
            pa.array([u[1] + u[3] for u in units] + [m[2] for m in marks], pa.int64()),
            pa.array([u[4] for u in units] + [None] * gone, pa.bool_()),
            pa.array([u[6] for u in units] + [None] * gone, pa.binary()),
        ],
        names=["shard", "doc", "rid", "first", "end", "whole", "symbols"],
    )


def _searched(docs: pa.Array, rids: np.ndarray, first: np.ndarray, whole: np.ndarray, symbols: list[bytes], window: int):
    """Marks (row, start, end) of the windows of a shard's units that also start earlier."""
    per_window = window // _SYMBOL
    order = np.array(_ranks(docs), np.int64)
    units = [np.frombuffer(s, np.uint64) for s in symbols]
    sizes = np.array([len(u) for u in units])
    _, every = np.unique(np.concatenate(units), return_inverse=True)
    every = every + 1
    unit = np.repeat(np.arange(len(units)), sizes)
    nth = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Symbols that follow each other are `_SYMBOL` words apart: a unit is that many sequences.
    lanes = np.where(whole, 1, _SYMBOL)
    lane, step = nth % lanes[unit], nth // lanes[unit]
    lane_size = -(-(sizes[:, None] - np.arange(_SYMBOL)) // lanes[:, None])
    lane_size = np.where(np.arange(_SYMBOL) < lanes[:, None], np.maximum(lane_size, 0) + 1, 0)
    lane_start = np.cumsum(lane_size.ravel()).reshape(lane_size.shape) - lane_size
    place = lane_start[unit, lane] + step
    text = np.zeros(int(lane_size.sum()), np.int64)
    text[place] = every
    index = FMIndex(text, per_window)
    # One window for each symbol that has enough symbols after it in its lane.
    begins = np.flatnonzero(step + per_window < lane_size[unit, lane])
    at = place[begins]
    patterns = text[at[:, None] + np.arange(per_window)]
    matched, low, high = index.search(patterns)
    found = np.flatnonzero(matched == per_window)
    if len(found) == 0:
        return []
    start = first[unit[begins]] + nth[begins] * np.where(whole, 0, 1)[unit[begins]]
    # Places in the corpus, as ranks by (document, first word); places outside count as last.
    span = int(start.max()) + 1
    corpus = np.full(len(text), np.iinfo(np.int64).max)
    corpus[at] = order[unit[begins]] * span + start
    ranges, which = np.unique(low[found], return_inverse=True)
    ends = np.zeros(len(ranges), np.int64)
    ends[which] = high[found]
    placed = np.append(corpus[index.places], np.iinfo(np.int64).max)
    smallest = np.minimum.reduceat(placed, np.column_stack([ranges, ends]).ravel())[::2]
    late = found[corpus[at[found]] != smallest[which]]
    # Windows that follow each other in a unit make one mark.
    owner, begin = unit[begins[late]], start[late]
    sort = np.lexsort((begin, owner))
    owner, begin = owner[sort], begin[sort]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(owner)) - 1
    return list(zip(owner[heads].tolist(), begin[heads].tolist(), (begin[tails] + window).tolist())) if len(owner) else []


def _marks(units: DataFrame, kind: str, window: int) -> DataFrame:
    """(rid, doc, start, end): words to remove, found in the shards."""

    def marked(docs, rids, found: list[tuple]) -> pa.RecordBatch:
        rows = [m[0] for m in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rids[rows] if rows else np.zeros(0, np.int64)),
                docs.take(pa.array(rows, pa.int64())),
                pa.array([m[1] for m in found], pa.int64()),
                pa.array([m[2] for m in found], pa.int64()),
            ],
            names=["rid", "doc", "start", "end"],
        )

    def one_shard(table: pa.Table) -> pa.RecordBatch:
        docs = table.column("doc").combine_chunks()
        rids, first, end = (table.column(c).to_numpy() for c in ("rid", "first", "end"))
        whole = table.column("whole").to_numpy(zero_copy_only=False).astype(bool)
        symbols = table.column("symbols").to_pylist()
        # Equal units of several tasks: all but the first are marked, and leave the index.
        order, best, found = _ranks(docs), {}, []
        for i, data in enumerate(symbols):
            key = (data, bool(whole[i]))
            old = best.get(key)
            if old is None:
                best[key] = i
                continue
            lost = i
            if (order[i], first[i]) < (order[old], first[old]):
                best[key], lost = i, old
            if (order[i], first[i]) != (order[old], first[old]):
                found.append((lost, int(first[lost]), int(end[lost]) + window - 1))
        kept = np.fromiter(best.values(), np.int64)
        here = docs.take(pa.array(kept))
        searched = _searched(here, rids[kept], first[kept], whole[kept], [symbols[i] for i in kept], window)
        found.extend((int(kept[r]), s, e) for r, s, e in searched)
        return marked(docs, rids, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if keys[low] != current and held:
                    yield one_shard(pa.Table.from_batches(held))
                    held = []
                current = keys[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield one_shard(pa.Table.from_batches(held))

    together = units.repartition("shard").sortWithinPartitions("shard")
    return together.mapInArrow(run, _MARK.format(kind=kind))


def dedup_substrings(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents without repeated passages, with `n_words`, `n_removed`, `removed_spans`.

    Words are runs of characters other than ASCII white space.  A word is removed if some
    window that covers it has the same words as a window that starts earlier: in a
    document with a smaller id, or further ahead in the same document.  Windows are judged
    on the input.  The text becomes the kept words, joined by one space; `removed_spans`
    are ranges of word numbers of the input.

    A null text has no words and becomes an empty text.  Rows without an id lose nothing
    and do not count.  Rows that share an id are judged each for itself; a window at the
    same place of another row with the same id is not earlier.  `window` is a multiple of
    five and at least ten.  Columns with the names of new ones are replaced.
    """
    if window % _SYMBOL or window < 2 * _SYMBOL:
        raise ValueError(f"window must be a multiple of {_SYMBOL}, and at least {2 * _SYMBOL}")
    kind = docs.schema[id_col].dataType.simpleString()
    doc, text = column(id_col), column(text_col)
    rows = docs.filter(doc.isNotNull()).select(doc.alias("doc"), _rid(doc, text).alias("rid"), text.alias("text"))
    described = written(_described(rows, kind), "described").filter(F.col("n_words") >= window)
    firsts = described.groupBy("same").agg(F.min("doc").alias("least"))
    copies = described.join(firsts, "same").filter("doc <> least").select("rid", "doc", "n_words")
    copies = written(copies.distinct(), "copies")
    gone = copies.select("rid", "doc")
    if copies.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    live = rows.join(gone, ["rid", "doc"], "left_anti").select("doc", "rid", "text").filter("text is not null")

    postings = _postings(live, window)
    counted = postings.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    counted = written(counted, "anchors")
    met = counted.agg(F.sum("n")).first()[0] or 0
    # Fewer anchors than the share's inverse are as common as this.
    common = F.col("n") > met // _COMMON_SHARE
    units = split_join(postings, counted, ["anchor"], common, F.xxhash64("rid", "place"))
    listed = units.groupBy("rid").agg(
        F.collect_list(F.struct("anchor", "place", (F.col("n") > HOT).alias("hot"))).alias("units"),
        F.sum(F.col("place") % _SHARES + window - _SYMBOL).alias("symbols"),
    )
    listed = written(listed, "units")
    total = listed.agg(F.sum("symbols")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_SYMBOLS))
    joined = _packed(live, kind).join(listed.drop("symbols"), "rid").select("doc", "rid", "packed", "units")
    sent = written(_sent_units(joined, kind, window, shards), "sent")
    marks = (
        _marks(sent.filter("shard is not null"), kind, window)
        .union(sent.filter("shard is null").select("rid", "doc", "first", "end"))
        .union(copies.select("rid", "doc", F.lit(0).cast("bigint"), "n_words"))
    )
    spans = marks.groupBy("rid", "doc").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    spans = spans.withColumnsRenamed({"rid": "__rid", "doc": "__doc"})
    return _without(docs, spans, doc, text, text_col)


def _merged(spans: pa.Array) -> list[tuple[int, int]]:
    flat = np.column_stack([spans.field("start").to_numpy(), spans.field("end").to_numpy()])
    result: list[list[int]] = []
    for start, end in sorted(map(tuple, flat.tolist())):
        if result and start <= result[-1][1]:
            result[-1][1] = max(result[-1][1], end)
        else:
            result.append([start, end])
    return [(s, e) for s, e in result]


def _without(docs: DataFrame, spans: DataFrame, doc: Column, text: Column, text_col: str) -> DataFrame:
    """Cut the marked words out of the texts."""
    new = ("n_words", "n_removed", "removed_spans")
    kept = others(docs, *new)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def pack(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        press = zstandard.ZstdCompressor(level=1)
        packed = [press.compress(t.as_buffer() if t.is_valid else b"") for t in text_of(batch, text_col)]
        return {"__packed": pa.array(packed, pa.binary())}

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        unpack = zstandard.ZstdDecompressor()
        texts, totals, removed, lists = [], [], [], []
        for packed, marks in zip(text_of(batch, "__packed"), text_of(batch, "__spans")):
            words = unpack.decompress(packed.as_buffer()).split()
            totals.append(len(words))
            gone = _merged(marks.values) if marks.is_valid else []
            for start, end in reversed(gone):
                del words[start:end]
            texts.append(b" ".join(words).decode())
            removed.append(totals[-1] - len(words))
            lists.append([{"start": s, "end": e} for s, e in gone])
        return {
            text_col: pa.array(texts, pa.string()),
            "n_words": pa.array(totals, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "removed_spans": pa.array(lists, pa.list_(span)),
        }

    keyed = docs.select(*(column(c) for c in kept), _rid(doc, text).alias("__rid0"))
    packed = with_results(keyed, "__packed binary", pack, drop=(text_col,))
    same = (F.col("__rid0") == F.col("__rid")) & (doc == F.col("__doc"))
    joined = packed.join(spans, same, "left").drop("__rid0", "__rid", "__doc")
    ddl = f"`{text_col}` string, n_words bigint, n_removed bigint, removed_spans array<struct<start:bigint,end:bigint>>"
    result = with_results(joined, ddl, cut, drop=("__packed", "__spans"))
    return result.select(*(column(c) for c in kept), *new)
