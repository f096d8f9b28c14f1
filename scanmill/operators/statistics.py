"""Corpus term statistics: document and collection frequency per term."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.functions.text import MAX_DOCUMENT_CHARS, MAX_TERM_CHARS, Analyzer
from scanmill.operators.documents import document_tokens, with_docid, with_status, with_tokens
from scanmill.runtime import exploded

DEFAULT_DF_MIN = 100


def in_df_range(stats: DataFrame, df_min: int = DEFAULT_DF_MIN, df_max: int | None = None) -> DataFrame:
    kept = stats.filter(F.col("df") >= df_min)
    return kept if df_max is None else kept.filter(F.col("df") <= df_max)


def term_frequencies(docs: DataFrame, analyzer: str | Analyzer, html: bool = True) -> DataFrame:
    """(docid, term, tf) of every usable document."""
    tokens = document_tokens(analyzer, html).alias("tokens")
    usable = with_status(with_docid(docs)).filter("status = 'ok'")
    return (
        exploded(usable.select("docid", tokens), "tokens", "term")
        .groupBy("docid", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def compute_term_statistics(
    docs: DataFrame,
    analyzer: str | Analyzer,
    df_min: int = DEFAULT_DF_MIN,
    df_max: int | None = None,
    html: bool = True,
    max_chars: int | None = MAX_DOCUMENT_CHARS,
    max_term_chars: int = MAX_TERM_CHARS,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """(term, df, cf) over the usable documents of (docid, content), or of what `analyzed` makes of them.

    With `by`, one such table for each value of these columns, which are kept.

    Each document contributes its tokens followed by its distinct tokens: the first
    part counts towards cf, the second towards df.  So one map-side-combined
    aggregation on `term` does it, and nothing is ever shuffled by document.
    """
    tokens = with_tokens(with_docid(docs), analyzer, html, max_chars).filter("status = 'ok'").select(*by, "tokens")
    parts = tokens.select(
        *by,
        F.size("tokens").alias("n"),
        F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("pos", "term"),
    )
    is_token = (F.col("pos") < F.col("n")).cast("bigint")
    stats = (
        parts.filter(F.length("term") <= max_term_chars)
        .groupBy(*by, "term")
        .agg(F.sum(1 - is_token).alias("df"), F.sum(is_token).alias("cf"))
    )
    return in_df_range(stats, df_min, df_max)


def merge_replacing(merged: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Merged statistics after one segment's have changed from `old` to `new`.

    Only that segment is counted again: its old counts are taken off the merged ones, and its
    new ones added.  All three have to be without a df threshold; terms that no segment holds
    any more are left out.
    """
    off = old.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    changed = merged.select("term", "df", "cf").unionByName(off).unionByName(new.select("term", "df", "cf"))
    sums = changed.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return sums.filter("df > 0")


def merge_term_statistics(
    *segments: DataFrame, df_min: int = DEFAULT_DF_MIN, df_max: int | None = None
) -> DataFrame:
    """Sum statistics over segments, then filter by df again.

    A term that a segment's own `df_min` dropped is lost for that segment; compute
    segments with `df_min=1` for exact totals.
    """
    union = reduce(DataFrame.unionByName, segments)
    merged = union.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return in_df_range(merged, df_min, df_max)
