"""Ranked retrieval: BM25 and query likelihood, all queries in one scan.

Every plan has the same shape: vectors -> scores of every document and query that meet,
made inside the row against the broadcast query terms -> best k per query, cut down in
each task.  Only what that leaves of each query is exchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanmill.functions import scoring
from scanmill.functions.text import Analyzer
from scanmill.operators import queries as Q
from scanmill.operators.numbering import dense_ids
from scanmill.operators.scan import Matches, Scorer, Sums, scan_scores
from scanmill.operators.vectors import postings
from scanmill.runtime import has_at_most, written

SCORE_DIGITS = 6
BROADCAST_BLOCKS = 1_000_000
_TIES = ("docid", "docid_desc")


def _rounded(score: Column, digits: int | None) -> Column:
    """Scores are rounded before ranking, so that ranks do not hang on the order in
    which partial sums happened to be added."""
    if digits is None:
        return score
    infinite = score == F.lit(float("-inf"))
    return F.when(infinite, score).otherwise(F.round(score, digits))


def top_k(
    scores: DataFrame, k: int, tie: str = "docid", tag: str = "run", deep_beyond: int | None = None
) -> DataFrame:
    """(qid, docid, rank, score, tag): the k best rows per query, rank from 1.

    Up to Spark's limit for cutting groups in each task (or `deep_beyond`), one task
    ranks a query.  For more, the rows that are left are ordered by ranges, and places
    are counted over all parts, so no task holds a whole query.
    """
    if tie not in _TIES:
        raise ValueError(f"unknown tie rule {tie!r}, expected one of {_TIES}")
    docid = F.col("docid").asc() if tie == "docid" else F.col("docid").desc()
    best = [F.col("score").desc(), docid]
    spark = scores.sparkSession
    limit = deep_beyond or int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        # First cut within many small groups of each query.
        slots = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        slot = F.pmod(F.xxhash64("docid"), F.lit(slots))
        part = Window.partitionBy("qid", "_slot").orderBy(*best)
        scores = (
            scores.withColumn("_slot", slot)
            .withColumn("rank", F.row_number().over(part))
            .filter(F.col("rank") <= k)
            .drop("_slot", "rank")
        )
        placed = dense_ids(scores.select("qid", "docid", "score"), [F.col("qid").asc(), *best], "_place")
        first = placed.groupBy("qid").agg(F.min("_place").alias("_first"))
        place = (F.col("_place") - F.col("_first") + 1).cast("int")
        ranked = placed.join(first, "qid").withColumn("rank", place)
    else:
        order = Window.partitionBy("qid").orderBy(*best)
        ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(
        "qid", "docid", "rank", "score", F.lit(tag).alias("tag")
    )


def bm25_scores(
    vectors: DataFrame,
    query_terms: DataFrame,
    n_docs: Column,
    k1: float = scoring.K1,
    b: float = scoring.B,
    average_length: float | Column | None = scoring.AVERAGE_LENGTH,
    k: int | None = None,
    margin: float = 0.0,
    small: bool = False,
) -> DataFrame:
    """(qid, docid, score) of every document that shares a term with a query.

    With `k`, rows more than `margin` below the k best of a query may be missing.
    """
    length = Q.average_length(vectors) if average_length is None else F.lit(average_length)
    weights = query_terms.select(
        "qid", "term_id", (F.col("qtf") * scoring.idf(F.col("df"), n_docs)).alias("weight")
    )

    def part(m: Matches) -> np.ndarray:
        return m.values["weight"] * scoring.bm25_term(m.tf, m.doc_len, m.average_length, k1, b)

    scorer = Scorer(part, lambda sums: sums.total)
    return scan_scores(vectors, weights, ["weight"], [], scorer, length, k, margin, small)


def _margin(digits: int | None) -> float:
    """Scores this close may be equal once they are rounded."""
    return 0.0 if digits is None else 2 * 10.0**-digits


def bm25_topk(
    vectors: DataFrame,
    dictionary: DataFrame,
    queries: DataFrame,
    k: int,
    analyzer: str | Analyzer = "porter",
    k1: float = scoring.K1,
    b: float = scoring.B,
    average_length: float | None = scoring.AVERAGE_LENGTH,
    n_docs: int | None = None,
    positive_only: bool = True,
    tie: str = "docid",
    digits: int | None = SCORE_DIGITS,
    row_key: list[str] | None = None,
    tag: str = "bm25",
    deep_beyond: int | None = None,
) -> DataFrame:
    """Best k documents per query (qid, text), by BM25 over flat or unique vectors.

    `average_length=None` measures it; `n_docs=None` counts the vectors.  With
    `positive_only=False`, documents without any query word score 0 and take part.  Each row
    is a document, whether or not rows share an id (`row_key` is not needed for that).
    """
    n = Q.document_count(vectors) if n_docs is None else F.lit(n_docs)

    def scored(asked: DataFrame, best: int | None) -> DataFrame:
        terms = Q.prepare_queries(asked, dictionary, analyzer, True)
        scores = bm25_scores(vectors, terms, n, k1, b, average_length, best, _margin(digits), True)
        return scores.withColumn("score", _rounded(F.col("score"), digits))

    def rank(asked: DataFrame) -> DataFrame:
        ranked = top_k(scored(asked, k).filter("score > 0"), k, tie, tag, deep_beyond)
        if positive_only:
            return ranked
        # Nothing at or below 0 is among the k best of a query with k positive scores.
        ranked = written(ranked, "run")
        full = F.broadcast(ranked.filter(F.col("rank") == k).select("qid"))
        rest = written(asked.join(full, "qid", "left_anti"), "queries")
        whole = ranked.join(full, "qid", "left_semi").select(ranked.columns)
        if rest.isEmpty():
            return whole
        scores = written(scored(rest, None), "scores")
        scores = scores.unionByName(_zero_scores(scores, vectors, rest, k, tie))
        return whole.unionByName(top_k(scores, k, tie, tag, deep_beyond))

    return Q.in_groups(queries, rank)


def _zero_scores(
    scores: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, tie: str, block: int = 4096
) -> DataFrame:
    """The first k documents per query, in tie order, that match none of its words.

    All non-matching documents score 0, so only the first k can ever be ranked.
    Documents are numbered in tie order and cut into blocks of at least k.  A query
    needs the blocks in which its count of non-matching documents is still below k:
    some blocks with matches, and at most one block without any.  No query meets
    documents of other blocks.
    """
    block = max(block, k)
    order = F.col("docid").asc() if tie == "docid" else F.col("docid").desc()
    numbered = dense_ids(vectors.select("docid"), [order], "_no", start=0)
    placed = numbered.select("docid", (F.col("_no") / block).cast("bigint").alias("_block"))
    hits = scores.select("qid", "docid").join(placed, "docid")
    counts = hits.groupBy("qid", "_block").agg(F.count(F.lit(1)).alias("_hits"))
    # One row per query and block with matches, in block order.
    by_query = Window.partitionBy("qid").orderBy("_block")
    before = by_query.rowsBetween(Window.unboundedPreceding, -1)
    free_before = F.col("_block") * block - F.coalesce(F.sum("_hits").over(before), F.lit(0))
    ranked = counts.select(
        "qid",
        "_block",
        free_before.alias("_free"),
        (F.row_number().over(by_query) - 1).alias("_nth"),
    )
    matched_blocks = ranked.filter(F.col("_free") < k).select("qid", "_block")
    # The first block without a match: the number of leading blocks that have one.
    gaps = ranked.groupBy("qid").agg(F.count_if(F.col("_block") == F.col("_nth")).alias("_gap"))
    first_free = (
        queries.select("qid")
        .distinct()
        .join(gaps, "qid", "left")
        .select("qid", F.coalesce("_gap", F.lit(0)).cast("bigint").alias("_block"))
    )
    needed = written(matched_blocks.unionByName(first_free), "blocks")
    # Many queries want the same first blocks: spread those documents before the join.
    wanted = placed.join(needed.select("_block").distinct(), "_block", "left_semi")
    free = wanted.repartition("docid").join(
        Q.bounded(needed, has_at_most(needed, BROADCAST_BLOCKS)), "_block"
    )
    free = free.join(
        scores.select("qid", "docid"), ["qid", "docid"], "left_anti"
    )
    zeros = free.select("qid", "docid", F.lit(0.0).alias("score"))
    return top_k(zeros, k, tie).select("qid", "docid", "score")


def likelihood_scores(
    vectors: DataFrame,
    query_terms: DataFrame,
    collection_size: Column,
    smoothing: float = scoring.SMOOTHING,
    background: str = "df",
    k: int | None = None,
    margin: float = 0.0,
    small: bool = False,
) -> DataFrame:
    """(qid, docid, score): log P(query | document) over the distinct query terms.

    Terms that a document lacks contribute as well, but what they contribute needs
    no join of candidates with absent terms.  With p(tf) the smoothed probability,

        sum over all terms of ln p(tf)
          = sum over matched terms of (ln p(tf) - ln p(0)) + sum over all terms of ln p(0)

    and the last sum depends on the document only through its length: it is
    `sum ln(c * background)`, a constant of the query, minus `terms * ln(len + mu)`
    for the Dirichlet prior.

    With `k`, rows more than `margin` below the k best of a query may be missing.
    """
    if background not in ("df", "cf"):
        raise ValueError(f"unknown background {background!r}, expected df|cf")
    mixing = scoring.is_jelinek_mercer(smoothing)
    # Weight of the background probability: what is left of ln p(0) without lengths.
    share = 1.0 - smoothing if mixing else smoothing
    p = F.col(background).cast("double") / collection_size
    absent = F.log(F.lit(share) * p) if share > 0 else F.lit(0.0)
    terms = query_terms.select("qid", "term_id", p.alias("p"), absent.alias("absent"))
    per_query = terms.groupBy("qid").agg(
        F.sum("absent").alias("absent_sum"), F.count(F.lit(1)).alias("n_terms")
    )
    # The driver collects these terms in parts of a bounded size.
    weights = terms.join(per_query, "qid")

    def part(m: Matches) -> np.ndarray:
        if mixing:
            present = np.log(scoring.likelihood(m.tf, m.doc_len, m.values["p"], smoothing))
        else:
            present = np.log(m.tf + smoothing * m.values["p"])
        return present - m.values["absent"]

    def score(sums: Sums) -> np.ndarray:
        n = sums.values["n_terms"]
        found = sums.total + sums.values["absent_sum"]
        if not mixing:
            found = found - n * np.log(sums.doc_len + smoothing)
        # Without background, a document that lacks a term is impossible.
        return found if share > 0 else np.where(sums.n_matched == n, found, -np.inf)

    names = ["p", "absent"], ["absent_sum", "n_terms"]
    return scan_scores(vectors, weights, *names, Scorer(part, score), None, k, margin, small)


def matching_pairs(
    vectors: DataFrame, query_terms: DataFrame, row_key: list[str] | None = None, small: bool | None = None
) -> DataFrame:
    """(qid, docid, term_id, tf): the query words that each document holds."""
    words = query_terms.select("qid", "term_id")
    entries, _ = postings(vectors, row_key)
    matched = entries.join(Q.bounded(words, small), "term_id")
    return matched.select("qid", "docid", "term_id", "tf")


def candidate_terms(
    run: DataFrame, vectors: DataFrame, query_terms: DataFrame, small: bool | None = None
) -> DataFrame:
    """(qid, docid, rank, term_id, tf): all words of the query for each row of a run, tf 0 if absent.

    Explains the scores of a ranked run: only the documents in it are looked at, and the
    result has its rows times the words of their queries.  Of vectors that share a docid,
    the largest tf counts.
    """
    ranked = run.select("qid", "docid", "rank")
    wanted = ranked.select("docid").distinct()
    chosen = vectors.join(Q.bounded(wanted, None), "docid", "left_semi")
    entries, _ = postings(chosen, ["docid"])
    tfs = entries.groupBy("docid", "term_id").agg(F.max("tf").alias("tf"))
    words = Q.bounded(query_terms.select("qid", "term_id"), small)
    return (
        ranked.join(words, "qid")
        .join(tfs, ["docid", "term_id"], "left")
        .select("qid", "docid", "rank", "term_id", F.coalesce("tf", F.lit(0)).alias("tf"))
    )


def lm_topk(
    vectors: DataFrame,
    dictionary: DataFrame,
    queries: DataFrame,
    k: int,
    smoothing: float = scoring.SMOOTHING,
    analyzer: str | Analyzer = "porter",
    background: str = "df",
    tie: str = "docid",
    digits: int | None = SCORE_DIGITS,
    row_key: list[str] | None = None,
    tag: str = "lmretrieval",
) -> DataFrame:
    """Best k documents per query by smoothed query likelihood.

    `smoothing` up to 1 is the Jelinek-Mercer weight, above 1 the Dirichlet prior.
    """
    size = Q.collection_size(dictionary)

    def rank(asked: DataFrame) -> DataFrame:
        terms = Q.prepare_queries(asked, dictionary, analyzer, True)
        scores = likelihood_scores(vectors, terms, size, smoothing, background, k, _margin(digits), True)
        return top_k(scores.withColumn("score", _rounded(F.col("score"), digits)), k, tie, tag)

    return Q.in_groups(queries, rank)
