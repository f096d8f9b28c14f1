"""Query preparation: analysis, dictionary lookup, idf and background statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.text import Analyzer, get_analyzer
from scanmill.runtime import exploded, has_at_most

# Queries up to this much text (16 MB, some 3 million words) are broadcast with their statistics.
BROADCAST_QUERY_BYTES = 16 << 20
# The same bound for prepared query terms, of about 64 bytes each.
BROADCAST_QUERY_TERMS = 1_000_000


def _text_bytes(queries: DataFrame) -> int:
    return queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def are_small(queries: DataFrame) -> bool:
    """Whether all the query text fits the broadcast bound."""
    return _text_bytes(queries) <= BROADCAST_QUERY_BYTES


def in_groups(queries: DataFrame, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rank a query set of any size: cut by query into groups that fit the broadcast bound.

    Each group is one more scan of the collection; postings are never shuffled by term.
    """
    size = _text_bytes(queries)
    if size <= BROADCAST_QUERY_BYTES:
        return rank(queries)
    # Groups are made by a hash, so they are planned half as large as they may be.
    groups = -(-2 * size // BROADCAST_QUERY_BYTES)
    group = F.pmod(F.xxhash64("qid"), F.lit(groups))
    return reduce(DataFrame.unionByName, [rank(queries.filter(group == g)) for g in range(groups)])


def bounded(df: DataFrame, small: bool | None) -> DataFrame:
    """Broadcast a side that was checked to be small; `None` checks it by its rows."""
    if small is None:
        small = has_at_most(df, BROADCAST_QUERY_TERMS)
    return F.broadcast(df) if small else df


def query_terms(queries: DataFrame, analyzer: str | Analyzer) -> DataFrame:
    """(qid, term, qtf): query words with their multiplicity."""
    tokens = get_analyzer(analyzer).tokens("text")
    return (
        exploded(queries.select("qid", tokens.alias("tokens")), "tokens", "term")
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("qtf"))
    )


def prepare_queries(
    queries: DataFrame, dictionary: DataFrame, analyzer: str | Analyzer, small: bool | None = None
) -> DataFrame:
    """(qid, term, term_id, qtf, df, cf); words outside the dictionary are dropped.

    The dictionary is scanned once and the query words are the broadcast side.
    """
    small = are_small(queries) if small is None else small
    terms = query_terms(queries, analyzer)
    return dictionary.join(bounded(terms, small), "term").select(
        "qid", "term", "term_id", "qtf", "df", "cf"
    )


def document_count(vectors: DataFrame) -> Column:
    """Number of vectors, empty ones included, as a scalar subquery."""
    return vectors.select(F.count(F.lit(1))).scalar()


def average_length(vectors: DataFrame) -> Column:
    return vectors.select(F.avg("doc_len")).scalar()


def collection_size(dictionary: DataFrame) -> Column:
    return dictionary.select(F.sum("cf")).scalar()
