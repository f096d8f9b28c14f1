"""Line dedup: keep a repeated line only in the first document that has it.

Lines are exploded and their normalised keys hashed (128 bits); a count of distinct
documents per hash tells which lines repeat; documents then lose those lines and are
put together again in line order.  The few hashes that are very common are broadcast, so
that no task gets all documents of one line.

Tasks emit one row per document and distinct key, so a line that stands in a third of
all documents is counted with partial sums, and what is joined back is a list of
(document, hash) pairs, never text.  Text is shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, others, split_join, text_of, with_results
from scanmill.runtime import written

# Keys of more than this share of all postings are broadcast.
_COMMON_SHARE = 1000
_SPACE = b" \t\n\v\f\r"
_PAIR = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())]))


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped line, A-Z lower-cased; none if it has too few code points."""
    key = line.strip(_SPACE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def _keys(text: str | None, min_chars: int) -> Iterator[bytes | None]:
    """One digest per line of the text; none for lines that are never dropped."""
    for line in (text or "").encode().split(b"\n"):
        key = _key(line, min_chars)
        yield None if key is None else xxhash.xxh3_128_digest(key)


def line_postings(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, h1, h2): each distinct key of each row with an id."""
    some = docs.filter(column(id_col).isNotNull()).select(
        column(id_col).alias("doc"), column(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(batch.column(1)):
                found = set(_keys(text.as_py(), min_chars)) - {None}
                digests.extend(found)
                rows.extend([row] * len(found))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            docs_ = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [docs_, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc", "h1", "h2"],
            )

    kind = some.schema["doc"].dataType.simpleString()
    return some.mapInArrow(run, f"doc {kind}, h1 bigint, h2 bigint")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 10,
    min_docs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents with repeated lines removed, and `n_lines`, `n_dropped`.

    A line counts by its key: white space stripped at both ends, A-Z lower-cased.  Keys
    of at least `min_chars` code points found in at least `min_docs` documents stay only
    in the document with the smallest id that has them, there with all their lines.

    A null or empty text is one empty line and comes back as an empty text.  Rows that
    share an id are one document.  Rows without an id keep all lines and do not count.
    Input columns named `n_lines` or `n_dropped` are replaced; all others are kept.
    """
    postings = written(line_postings(docs, min_chars, id_col, text_col), "line-keys")
    counted = postings.distinct().groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("doc").alias("keeper")
    )
    repeated = written(counted.filter(F.col("n") >= min_docs), "repeated-lines")
    # Fewer keys than the share's inverse are as common as this.
    common = F.col("n") > postings.count() // _COMMON_SHARE
    drops = (
        split_join(postings, repeated, ["h1", "h2"], common, F.xxhash64("doc", "h2"))
        .filter(F.col("doc") != F.col("keeper"))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drops"))
        .withColumnRenamed("doc", "__doc")
    )
    found = docs.select(*(column(c) for c in others(docs, "n_lines", "n_dropped")))
    joined = found.join(drops, column(id_col) == F.col("__doc"), "left").drop("__doc")

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, totals, dropped = [], [], []
        drop_lists = text_of(batch, "__drops")
        for text, drop in zip(text_of(batch, text_col), drop_lists):
            lines = (text.as_py() or "").split("\n")
            totals.append(len(lines))
            if not drop.is_valid:
                texts.append("\n".join(lines))
                dropped.append(0)
                continue
            pairs = drop.values
            flat = np.column_stack([pairs.field("h1").to_numpy(), pairs.field("h2").to_numpy()])
            bad = {flat[i].astype("<i8").tobytes() for i in range(len(flat))}
            kept = [s for s, k in zip(lines, _keys(text.as_py(), min_chars)) if k not in bad]
            texts.append("\n".join(kept))
            dropped.append(len(lines) - len(kept))
        return {
            text_col: pa.array(texts, pa.string()),
            "n_lines": pa.array(totals, pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64()),
        }

    result = with_results(
        joined, f"`{text_col}` string, n_lines bigint, n_dropped bigint", make, drop=("__drops",)
    )
    return result.select(*(column(c) for c in found.columns), "n_lines", "n_dropped")
