"""Human-readable corpus dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.functions.text import (
    MAX_DOCUMENT_CHARS,
    Analyzer,
    collapse_newlines,
    get_analyzer,
)
from scanmill.operators.documents import (
    document_text,
    document_tokens,
    with_docid,
    with_status,
)
from scanmill.operators.vectors import BROADCAST_TERMS, encode_tokens


def dump_plain_text(docs: DataFrame, html: bool = True) -> DataFrame:
    """(docid, text): `standard` tokens joined by `|`, at any length; unreadable pages left out."""
    pages = with_status(with_docid(docs), max_chars=None).filter("status = 'ok'")
    tokens = get_analyzer("standard").tokens(collapse_newlines(document_text(html)))
    return pages.select("docid", F.array_join(tokens, "|").alias("text"))


def dump_term_ids(
    docs: DataFrame,
    dictionary: DataFrame,
    analyzer: str | Analyzer = "standard",
    html: bool = True,
    max_chars: int | None = MAX_DOCUMENT_CHARS,
    row_key: list[str] | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(docid, ids): `[1, 2, 3]` in document order; an unusable page gives an empty string."""
    pages = with_status(with_docid(docs), max_chars)
    tokens = pages.withColumn("tokens", document_tokens(analyzer, html))
    coded = encode_tokens(tokens, dictionary, ["docid", "status"], row_key, broadcast_terms)
    listed = F.concat(
        F.lit("["), F.array_join(F.col("term_ids").cast("array<string>"), ", "), F.lit("]")
    )
    ids = F.when(F.col("status") == "ok", listed).otherwise(F.lit(""))
    return coded.select("docid", ids.alias("ids"))
