"""The scan of a ranking: all queries against every document, inside the row.

The query terms are turned round, term -> (query, weight), and broadcast.  A document's
terms lie in one row, so a batch of rows is matched, summed by document and query, and cut
down to what can still be among the best of a query, before anything is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanmill.runtime import written

# Matches that a task works on at once: about 100 MB of arrays.
_MATCHES = 1 << 20
# Entries of one query table; larger sets of queries are one scan for each part.
MAX_ENTRIES = 1_000_000


@dataclass(frozen=True)
class Matches:
    """Matches of documents with query terms, one entry each; `values` has the term's columns."""

    tf: np.ndarray
    doc_len: np.ndarray
    average_length: np.ndarray
    values: dict[str, np.ndarray]


@dataclass(frozen=True)
class Sums:
    """Sums of matches, one entry for each document and query that meet."""

    total: np.ndarray
    n_matched: np.ndarray
    doc_len: np.ndarray
    values: dict[str, np.ndarray]  # of the query


@dataclass(frozen=True)
class Scorer:
    """How matches become scores: a part for each match, then something of their sum."""

    part: Callable[[Matches], np.ndarray]
    score: Callable[[Sums], np.ndarray]


@dataclass(frozen=True)
class QueryTable:
    """Query terms by term: `offsets` says where the entries of each of `term_ids` begin."""

    term_ids: np.ndarray
    offsets: np.ndarray
    query: np.ndarray
    values: dict[str, np.ndarray]
    qids: pa.Array
    query_values: dict[str, np.ndarray]

    @staticmethod
    def of(table: pa.Table, values: list[str], query_values: list[str]) -> QueryTable:
        coded = table.column("qid").combine_chunks().dictionary_encode()
        query = coded.indices.to_numpy().astype(np.int64)
        terms = table.column("term_id").to_numpy().astype(np.int64)
        order = np.lexsort((query, terms))
        distinct, first = np.unique(terms[order], return_index=True)
        _, example = np.unique(query, return_index=True)
        column = {name: table.column(name).to_numpy() for name in [*values, *query_values]}
        return QueryTable(
            distinct,
            np.append(first, len(terms)),
            query[order],
            {name: column[name][order] for name in values},
            coded.dictionary,
            {name: column[name][example] for name in query_values},
        )

    def places(self, term_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some ids are of a query, and where these stand in the table."""
        if not len(self.term_ids):
            return np.zeros(len(term_ids), bool), np.zeros(0, np.int64)
        at = np.searchsorted(self.term_ids, term_ids)
        at[at == len(self.term_ids)] = 0
        found = self.term_ids[at] == term_ids
        return found, at[found]


def _found(terms: pa.Array, table: QueryTable, flat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, tf) of the query terms in a column of vectors."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(terms)), lengths)
    entries = terms.flatten()
    ids = entries if flat else entries.field("term_id")
    found, places = table.places(ids.to_numpy(zero_copy_only=False))
    rows = rows[found]
    if not flat:
        return rows, places, entries.field("tf").to_numpy(zero_copy_only=False)[found]
    width = max(1, len(table.term_ids))
    pairs, tf = np.unique(rows * width + places, return_counts=True)
    return pairs // width, pairs % width, tf


def _portions(rows: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of whole rows that expand to a bounded number of matches, or to those of one row."""
    upto = np.cumsum(sizes)
    start = 0
    while start < len(rows):
        before = upto[start] - sizes[start]
        end = int(np.searchsorted(upto, before + _MATCHES, side="right"))
        if end < len(rows):
            # Step back to where a row begins, or take all of the first row.
            end = int(np.searchsorted(rows, rows[end]))
        if end <= start:
            end = int(np.searchsorted(rows, rows[start], side="right"))
        yield slice(start, end)
        start = end


class _Cut:
    """Drops what cannot be among a query's best k, by the k-th best that the task has seen."""

    def __init__(self, queries: int, k: int | None, margin: float) -> None:
        self.k, self.margin = k, margin
        self.least = np.full(queries, -np.inf)

    def __call__(self, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        if self.k is None:
            return np.arange(len(query))
        order = np.lexsort((-score, query))
        ordered = query[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
        ends = np.append(starts[1:], len(order))
        full = starts[ends - starts >= self.k] + self.k - 1
        kth = score[order[full]]
        self.least[ordered[full]] = np.maximum(self.least[ordered[full]], kth)
        # Scores are rounded later: those that may round to the same stay.
        return np.flatnonzero(score >= self.least[query] - self.margin)


def scan_scores(
    vectors: DataFrame,
    query_terms: DataFrame,
    values: list[str],
    query_values: list[str],
    scorer: Scorer,
    average_length: Column | None = None,
    k: int | None = None,
    margin: float = 0.0,
    small: bool = False,
) -> DataFrame:
    """(qid, docid, score) of every document and query that share a term.

    `query_terms` has qid, term_id and the columns in `values` (of a term in a query) and
    `query_values` (of a query).  With `k`, rows that are `margin` below the k-th best of their
    query, in one task, may be missing.  Each row of `vectors` is a document of its own.  Query
    terms are counted, and cut into groups if they are many, unless they are known to be few.
    """
    flat = "terms" not in vectors.columns
    source = vectors.select(
        "docid",
        F.col("doc_len").cast("double").alias("doc_len"),
        (F.lit(0.0) if average_length is None else average_length.cast("double")).alias("average_length"),
        F.col("term_ids" if flat else "terms").alias("terms"),
    )
    kinds = {f.name: f for f in [*query_terms.schema.fields, *vectors.schema.fields]}
    schema = StructType().add(kinds["qid"]).add(kinds["docid"]).add("score", "double")

    def run(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def batches_scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: QueryTable = shared.value
            cut = _Cut(len(table.qids), k, margin)
            sizes_of = np.diff(table.offsets)
            for batch in batches:
                rows, places, tf = _found(batch.column(3), table, flat)
                lengths, averages = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                sizes = sizes_of[places]
                for part in _portions(rows, sizes):
                    n = sizes[part]
                    at = np.repeat(np.arange(part.start, part.stop), n)
                    entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + table.offsets[places[at]]
                    row = rows[at]
                    matches = Matches(
                        tf[at].astype(np.float64), lengths[row], averages[row],
                        {name: v[entry] for name, v in table.values.items()},
                    )
                    width = len(table.qids)
                    pairs, inverse, n_matched = np.unique(
                        row * width + table.query[entry], return_inverse=True, return_counts=True
                    )
                    total = np.bincount(inverse, scorer.part(matches), len(pairs))
                    row, query = pairs // width, pairs % width
                    of_query = {name: v[query] for name, v in table.query_values.items()}
                    score = scorer.score(Sums(total, n_matched, lengths[row], of_query))
                    kept = cut(query, score)
                    yield pa.RecordBatch.from_arrays(
                        [table.qids.take(pa.array(query[kept])), batch.column(0).take(pa.array(row[kept])), pa.array(score[kept])],
                        names=["qid", "docid", "score"],
                    )

        return batches_scored

    spark = vectors.sparkSession
    wanted = query_terms.select("qid", "term_id", *values, *query_values)
    groups = 1
    if not small:
        wanted = written(wanted, "query-terms")
        entries = wanted.count()
        groups = 1 if entries <= MAX_ENTRIES else -(-2 * entries // MAX_ENTRIES)
    scans = []
    for g in range(groups):
        some = wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g) if groups > 1 else wanted
        shared = spark.sparkContext.broadcast(QueryTable.of(some.toArrow(), values, query_values))
        scans.append(source.mapInArrow(run(shared), schema))
    return reduce(DataFrame.unionByName, scans)
