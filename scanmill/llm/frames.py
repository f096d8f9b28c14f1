"""Small helpers for DataFrames shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanmill.runtime import written

Columns = dict[str, pa.Array]


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of a frame other than the named ones; case does not tell names apart."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def with_results(
    df: DataFrame,
    added: str,
    make: Callable[[pa.RecordBatch], Columns],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append columns that `make` computes from an Arrow batch.

    A column of the input that has the name of a new one is replaced by it; those
    in `drop` are left out.
    """
    new = StructType.fromDDL(added)
    keep = others(df, *new.fieldNames(), *drop)
    fields = {f.name: f for f in df.schema.fields}
    schema = StructType([*(fields[k] for k in keep), *new.fields])
    positions = [df.columns.index(k) for k in keep]
    names = new.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = make(batch)
            arrays = [batch.column(p) for p in positions] + [found[n] for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.mapInArrow(run, schema)


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch; other types of column are refused by Spark earlier."""
    return batch.column(batch.schema.get_field_index(name))


# Groups with more than this share of all rows are joined by broadcast: there are fewer of
# them than its inverse.
_HOT_SHARE = 1000
_SMALL_BYTES = 16 << 20


def split_join(
    left: DataFrame, right: DataFrame, keys: list[str], is_hot: Column, spread: Column
) -> DataFrame:
    """Inner join on long keys, in which no task gets all rows of a hot key.

    `right` has one row a key, in a written table; those that are hot, of which the caller
    bounds the number, are broadcast.  Rows of `left` with a hot key are then dealt by
    `spread`, any long that differs between them, so `left` is read once.
    """
    values = [c for c in right.columns if c not in keys]
    found = F.struct(*(column(v) for v in values))
    hot = right.filter(is_hot).select(*(column(k).alias(f"__hot_{k}") for k in keys), found.alias("__hot"))
    cold = right.filter(~is_hot).select(*(column(k).alias(f"__cold_{k}") for k in keys), found.alias("__cold"))
    near = left.join(F.broadcast(hot), [column(k) == F.col(f"__hot_{k}") for k in keys], "left")
    first = F.when(F.col("__hot").isNull(), column(keys[0])).otherwise(spread).alias("__dealt")
    dealt = near.select(*(column(c) for c in left.columns), "__hot", first)
    same = [F.col("__dealt") == F.col(f"__cold_{keys[0]}")]
    same += [column(k) == F.col(f"__cold_{k}") for k in keys[1:]]
    # A spread row may meet another key's value by chance; its own comes first.
    joined = dealt.join(cold, same, "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    joined = joined.filter(F.col("__found").isNotNull())
    return joined.select(*(column(c) for c in left.columns), *(F.col("__found")[v].alias(v) for v in values))


def with_group_values(rows: DataFrame, group_col: str, values: DataFrame, count_col: str) -> DataFrame:
    """Rows with the columns of their group; null groups are equal to each other.

    `values` has one row a group: the group, its number of rows (left out of the result) and
    the columns to add, which replace those of `rows`.  It is broadcast if it is small.  If
    not, only the few groups with over a thousandth of all rows are, and the other rows,
    none of a hot group, meet their values in a shuffle join.
    """
    values = written(values, "groups")
    size = F.coalesce(F.octet_length(column(group_col).cast("string")), F.lit(0)) + 64
    held, total = values.agg(F.sum(size), F.sum(column(count_col))).first()
    added = others(values, group_col, count_col)
    rows = rows.select(*(column(c) for c in others(rows, *added)))

    def joined(left: DataFrame, right: DataFrame, hint: bool) -> DataFrame:
        right = right.select(column(group_col).alias("__group"), *(column(c) for c in added))
        right = F.broadcast(right) if hint else right
        return left.join(right, column(group_col).eqNullSafe(F.col("__group"))).drop("__group")

    if (held or 0) <= _SMALL_BYTES:
        return joined(rows, values, True)
    is_hot = column(count_col) > total // _HOT_SHARE
    hot = values.filter(is_hot).select(column(group_col).alias("__hot"))
    cold = rows.join(F.broadcast(hot), column(group_col).eqNullSafe(F.col("__hot")), "left_anti")
    return joined(rows, values.filter(is_hot), True).unionByName(joined(cold, values.filter(~is_hot), False))
