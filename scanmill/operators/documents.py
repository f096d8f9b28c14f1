"""Document-level steps shared by all corpus jobs: ids, status, tokens, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scanmill.functions.text import (
    MAX_DOCUMENT_CHARS,
    Analyzer,
    get_analyzer,
    html_to_text,
)
from scanmill.runtime import written


def with_docid(docs: DataFrame) -> DataFrame:
    """Only records that carry a document id are pages."""
    return docs.filter(F.col("docid").isNotNull())


def document_status(max_chars: int | None = MAX_DOCUMENT_CHARS) -> Column:
    """`ok`, `too_long`, `error` (no readable content) or `no_docid`."""
    status = F.when(F.col("docid").isNull(), "no_docid").when(F.col("content").isNull(), "error")
    if max_chars is not None:
        status = status.when(F.length("content") > max_chars, "too_long")
    return status.otherwise("ok")


def with_status(docs: DataFrame, max_chars: int | None = MAX_DOCUMENT_CHARS) -> DataFrame:
    return docs.withColumn("status", document_status(max_chars))


def document_text(html: bool) -> Column:
    return html_to_text("content") if html else F.col("content")


def document_tokens(analyzer: str | Analyzer, html: bool) -> Column:
    """Tokens of usable documents; null for the others, which costs no analysis."""
    readable = F.when(F.col("status") == "ok", F.col("content"))
    text = html_to_text(readable) if html else readable
    return get_analyzer(analyzer).tokens(text)


def with_tokens(
    docs: DataFrame, analyzer: str | Analyzer, html: bool, max_chars: int | None = MAX_DOCUMENT_CHARS
) -> DataFrame:
    """Add `status` and `tokens` to (docid, content); what `analyzed` has made has them and no content."""
    if "content" not in docs.columns:
        return docs
    return with_status(docs, max_chars).withColumn("tokens", document_tokens(analyzer, html))


def analyzed(
    docs: DataFrame, analyzer: str | Analyzer, html: bool = True, max_chars: int | None = MAX_DOCUMENT_CHARS
) -> DataFrame:
    """`docs` with `status` and `tokens` in place of `content`, written.

    Statistics and vectors of one collection need the same tokens; given this table, neither
    analyzes a text again.  Both take its analyzer and length cap as settled.
    """
    return written(with_tokens(docs, analyzer, html, max_chars).drop("content"), "tokens")


def counters() -> list[Column]:
    """Aggregates of the corpus counters over a frame with `status`."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count("docid").alias("pages"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "too_long").alias("too_long"),
    ]


def corpus_health(docs: DataFrame, max_chars: int | None = MAX_DOCUMENT_CHARS) -> DataFrame:
    """One row: total records, pages, errors, over-long documents."""
    return with_status(docs, max_chars).agg(*counters())


def observe_health(
    docs: DataFrame, name: str = "corpus", max_chars: int | None = MAX_DOCUMENT_CHARS
) -> tuple[DataFrame, Observation]:
    """The same counters, gathered in flight while another job consumes the frame."""
    observation = Observation(name)
    return with_status(docs, max_chars).observe(observation, *counters()), observation


def count_records(records: DataFrame) -> DataFrame:
    """One row: all records, and those with a document id."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count("docid").alias("pages"))
