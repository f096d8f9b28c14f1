"""Mix sources to target weights with a hierarchical token budget.

Weights form a tree, here domain, language, source.  A token budget flows from the root
to the leaves in proportion to the weights.  A node that cannot use its share (it has
too few tokens, even when repeated `max_epochs` times) leaves the rest to its siblings;
only what a whole family cannot use goes back to the siblings of its parent.

Each leaf then takes its budget from a sequence of epochs: whole passes over the leaf,
then a prefix of one more pass, in an order seeded by the epoch.

Nothing orders a whole leaf in one task: the order keys are cut into `buckets` ranges,
sums per range find the range in which the budget ends, and only its rows are sorted.
What reaches the driver is one row per leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.llm.frames import column, others, text_of, with_results
from scanmill.llm.textscan import NOT_SPACE, blocks
from scanmill.runtime import written

Path = tuple[str | None, ...]

MAX_LEAVES = 100_000
_BUCKET_DIGITS = 3  # hexadecimal digits of an order key that name its range


def allocate(capacities: Mapping[Path, int], weights: Mapping[Path, int], budget: int) -> dict[Path, int]:
    """Tokens per leaf, from the capacities of the leaves.

    `weights` gives nodes (paths from the root) an integer weight; others have weight 1,
    and weight 0 shuts a node out.  Fractions are rounded down.
    """
    if not capacities:
        return {}
    depth = len(next(iter(capacities)))
    usable: dict[Path, int] = {}
    for leaf, capacity in capacities.items():
        open_ = all(weights.get(leaf[: i + 1], 1) > 0 for i in range(depth))
        for i in range(depth + 1):
            node = leaf[:i]
            usable[node] = usable.get(node, 0) + (capacity if open_ else 0)
    granted: dict[Path, int] = {(): min(budget, usable[()])}
    for level in range(1, depth + 1):
        families: dict[Path, list[Path]] = {}
        for node in usable:
            if len(node) == level:
                families.setdefault(node[:-1], []).append(node)
        for parent, children in families.items():
            granted |= _share(
                {c: usable[c] for c in children},
                {c: weights.get(c, 1) for c in children},
                granted[parent],
            )
    return {leaf: granted[leaf] for leaf in capacities}


def _share(usable: dict[Path, int], weights: dict[Path, int], budget: int) -> dict[Path, int]:
    """Split a budget among siblings; what one cannot use goes to the others."""
    given = {child: 0 for child in usable}
    left = [c for c in usable if weights[c] > 0]
    left.sort(key=lambda c: usable[c] / weights[c])
    weight = sum(weights[c] for c in left)
    while left and usable[left[0]] * weight <= budget * weights[left[0]]:
        child = left.pop(0)
        given[child] = usable[child]
        budget -= usable[child]
        weight -= weights[child]
    for child in left:
        given[child] = budget * weights[child] // weight
    return given


def _order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """Add `n_tokens`: runs of characters other than ASCII white space."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts = np.zeros(batch.num_rows, np.int64)
        for block in blocks(text_of(batch, text_col)):
            inside = NOT_SPACE[block.data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = block.offsets[:-1]
            starts = starts[starts < len(inside)]
            first[starts] = inside[starts]
            sums = np.concatenate([[0], np.cumsum(first)])
            counts[block.first : block.first + block.rows] = np.diff(sums[block.offsets])
        return {"n_tokens": pa.array(counts)}

    return with_results(docs, "n_tokens bigint", make)


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Mapping[Path, int],
    total_tokens: int | None = None,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The chosen documents, with the levels, `n_tokens`, and `n_epochs` (copies to take).

    `levels` names the tree's levels from the top, each an SQL expression over `docs`.  The budget is `total_tokens`, or else `share` (a fraction) of all tokens.
    A leaf takes all its rows once per whole epoch that fits in its budget, then the
    longest prefix of the next epoch that fits.

    Rows that share an id stand at one place of the order and are taken together.  A null
    id stands at the place of the empty string; a null level is a branch of its own.  An
    empty table gives an empty result.  Columns with the names of new ones are replaced.
    More than `MAX_LEAVES` leaves are an error, as the tree is held by the driver.
    """
    names = list(levels)
    new = [*names, "n_tokens", "n_epochs"]
    kept = [column(c) for c in others(docs, *new)]
    placed = docs.select(*kept, *(F.expr(e).cast("string").alias(n) for n, e in levels.items()))
    narrow = _counted(
        placed.select(column(id_col).alias("__id"), column(text_col).alias("__text"), *names), "__text"
    ).drop("__text")
    narrow = written(narrow, "mix-tokens")
    sums = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = sums.limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"the tree of sources has more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[n] for n in names): int(r["tokens"]) for r in leaves}
    if total_tokens is None:
        total_tokens = sum(tokens.values()) * share[0] // share[1]
    grants = allocate({p: t * max_epochs for p, t in tokens.items()}, weights, total_tokens)
    cuts = _cuts(narrow, names, tokens, grants, seed)
    leaf = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    chosen = placed.join(F.broadcast(cuts), leaf, "inner")
    in_prefix = _order_key(seed, F.col("__full"), column(id_col)) <= F.col("__cut")
    copies = (F.col("__full") + in_prefix.cast("bigint")).alias("n_epochs")
    chosen = chosen.select(*kept, *names, copies).filter("n_epochs > 0")
    return _counted(chosen, text_col).select(*kept, *new)


def _cuts(
    narrow: DataFrame, names: list[str], tokens: dict[Path, int], grants: dict[Path, int], seed: int
) -> DataFrame:
    """(__level..., __full, __cut) per leaf: whole epochs, and the last order key of the rest."""
    spark = narrow.sparkSession
    plan = [
        (*path, *((grants[path] // t, grants[path] % t) if t else (0, 0))) for path, t in tokens.items()
    ]
    ddl = ", ".join(f"`__{n}` string" for n in names) + ", __full bigint, __rest bigint"
    grant = F.broadcast(spark.createDataFrame(plan, ddl))
    keys = [f"__{n}" for n in names]
    leaf = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    ordered = narrow.join(grant, leaf).select(
        *keys, "__full", "__rest", "n_tokens", _order_key(seed, F.col("__full"), F.col("__id")).alias("key")
    )
    ordered = ordered.withColumn("range", F.substring("key", 1, _BUCKET_DIGITS))
    by_range = ordered.groupBy(*keys, "__full", "__rest", "range").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*keys).orderBy("range")
    summed = by_range.withColumn("upto", F.sum("held").over(before))
    # A leaf has at most one range in which its budget ends.
    last = (
        summed.filter(F.col("upto") > F.col("__rest"))
        .groupBy(*keys)
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("held")).alias("base"))).alias("at"))
        .select(*(F.col(k).alias(f"{k}_") for k in keys), "at.*")
        .withColumnRenamed("range", "__range")
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    edge = ordered.join(F.broadcast(last), [*same, F.col("range") == F.col("__range")])
    inside = Window.partitionBy(*keys, "range").orderBy("key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fits = F.col("base") + F.sum("n_tokens").over(inside) <= F.col("__rest")
    found = edge.select(*keys, "__range", F.when(fits, F.col("key")).alias("key"))
    found = found.groupBy(*keys).agg(
        F.coalesce(F.max("key"), F.max("__range")).alias("__cut")
    )
    found = found.select(*(F.col(k).alias(f"{k}_") for k in keys), "__cut")
    # An empty rest takes nothing; other rests end in some range, as they are less than the leaf.
    cut = F.when(F.col("__rest") > 0, F.col("__cut")).otherwise(F.lit(""))
    return written(grant.join(found, same, "left").select(*keys, "__full", cut.alias("__cut")), "mix-cuts")


def repeated(mixed: DataFrame) -> DataFrame:
    """One row per document and epoch (from 0) of a result of `mix_sources`."""
    epochs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_epochs") - 1)).alias("epoch")
    return mixed.select(*(column(c) for c in others(mixed, "epoch")), epochs)


__all__ = ["allocate", "mix_sources", "repeated"]
