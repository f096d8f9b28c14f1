"""Dense numbering in a global order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.runtime import written

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted by `order`, positions frozen in a table.

    `_part` grows with the order, `_row` counts from 0 within a part.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    frozen = written(placed.withColumn("_slot", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_slot", _ROW_BITS).cast("int")
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return frozen.select(*df.columns, part.alias("_part"), row.alias("_row"))


def _starts(sizes: DataFrame) -> DataFrame:
    """First number of each part; as many rows as there are range partitions."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0))
    return sizes.select("_part", start.alias("_start"))


def dense_ids(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Add `name` = start, start+1, ... in the given order (a unique key).

    One range shuffle writes the sorted rows; part sizes, a handful of rows, give
    each part its offset.
    """
    frozen = ranged(df, order)
    sizes = frozen.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    number = F.col("_start") + F.col("_row") + start
    return frozen.join(F.broadcast(_starts(sizes)), "_part").select(
        *df.columns, number.alias(name)
    )


def dense_ids_of_copies(
    df: DataFrame, key: str, name: str, start: int = 1, chunk: int = 100_000
) -> DataFrame:
    """Number the rows of a one-column table that may hold many copies of a key.

    Copies are counted before the range shuffle, so a key that fills a third of the
    input is one row there.  Its numbers are laid out again in chunks, each of them
    a row of its own that can go to any task.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    frozen = ranged(counted, [F.col(key).asc()])
    within = (
        Window.partitionBy("_part")
        .orderBy("_row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = frozen.groupBy("_part").agg(F.sum("_copies").alias("_size"))
    first = F.col("_start") + F.coalesce(F.sum("_copies").over(within), F.lit(0)) + start
    placed = frozen.join(F.broadcast(_starts(sizes)), "_part").select(
        key, "_copies", first.alias("_first")
    )
    single = placed.filter("_copies = 1").select(key, F.col("_first").alias(name))
    last = F.col("_copies") - 1
    chunks = placed.filter("_copies > 1").select(
        key, "_copies", "_first", F.explode(F.sequence(F.lit(0), last, F.lit(chunk))).alias("_from")
    )
    spread = chunks.repartition(key, "_from")
    upto = F.least(F.col("_from") + (chunk - 1), last)
    repeated = spread.select(
        key, F.explode(F.sequence(F.col("_first") + F.col("_from"), F.col("_first") + upto)).alias(name)
    )
    return single.unionByName(repeated)
