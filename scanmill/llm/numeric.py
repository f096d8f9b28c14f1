"""Vector columns as exact integers, and exact sums of them over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column

INTEGERS = "__integers"

# Beyond this, a component makes its row unusable: sums over any table still fit 38 digits.
_MOST = float(1 << 40)


def with_integers(rows: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows whose vector is all finite numbers, with `__integers`: floor(scale * component).

    Rows with a null vector, or null or non-finite components, are dropped.  `__integers`
    is null for an empty vector and for one with a component beyond 2^40 after scaling.
    """
    vector = column(vector_col)
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    kept = rows.filter(vector.isNotNull() & finite)
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    usable = (F.size(vector) > 0) & F.forall(scaled, lambda c: F.abs(c) <= F.lit(_MOST))
    return kept.withColumn(INTEGERS, F.when(usable, F.transform(scaled, lambda c: F.floor(c))))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with `__integers` null unless of the commonest length, and that length.

    Ties go to the longer; the length is 0 if no row has integers.
    """
    sizes = rows.filter(F.col(INTEGERS).isNotNull()).groupBy(F.size(INTEGERS).alias("size"))
    common = sizes.count().orderBy(F.desc("count"), F.desc("size")).first()
    length = common["size"] if common else 0
    return rows.withColumn(INTEGERS, F.when(F.size(INTEGERS) == length, F.col(INTEGERS))), length


def matrix(arrays: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of an Arrow column of lists that are not null: their indexes, and (n, length) values."""
    there = np.flatnonzero(arrays.is_valid().to_numpy(zero_copy_only=False))
    flat = arrays.drop_null().flatten().to_numpy(zero_copy_only=False)
    return there, flat.reshape(len(there), length)


def exact_sums(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One batch (slot, position, total, n) out of pieces (slots, sums of each slot, rows of each slot).

    Totals are added as Python integers, once a piece, and sent with 38 digits.
    """
    totals: dict[int, list] = {}
    for slots, sums, counts in parts:
        for slot, row, n in zip(slots.tolist(), sums.tolist(), counts.tolist()):
            held = totals.get(slot)
            totals[slot] = [n, row] if held is None else [held[0] + n, [a + b for a, b in zip(held[1], row)]]
    entries = [(s, p, t, n) for s, (n, row) in totals.items() for p, t in enumerate(row)]
    columns = list(zip(*entries)) or [(), (), (), ()]
    kinds = [pa.int32(), pa.int32(), pa.decimal128(38), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["slot", "position", "total", "n"]
    )


SUMS = "slot int, position int, total decimal(38,0), n bigint"


def added(sums: DataFrame) -> dict[int, tuple[list[int], int]]:
    """Sums over all tasks, by slot: the totals by position, and the number of rows.

    As many rows as slots times positions come to the driver, whatever the input's size.
    """
    rows = sums.groupBy("slot", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found: dict[int, tuple[list[int], int]] = {}
    for row in sorted(rows, key=lambda r: (r["slot"], r["position"])):
        found.setdefault(row["slot"], ([], row["n"]))[0].append(int(row["total"]))
    return found
