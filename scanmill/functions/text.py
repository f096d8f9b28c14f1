"""Text scalars as Column expressions: header stripping, markup, analyzers.

All of it runs in the JVM apart from the text of HTML pages and Porter stemming, which get
Arrow batches of pages and of tokens.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanmill.functions import patterns
from scanmill.functions.markup import visible_texts
from scanmill.functions.stemming import stem_tokens
from scanmill.functions.words import ENGLISH_STOP_WORDS, FUNCTION_WORDS

# The limits that the results of a collection hang on.
MAX_DOCUMENT_CHARS = 512 * 1024
MAX_TERM_CHARS = 64
MAX_TOKEN_CHARS = 255


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- WARC bodies ---------------------------------------------------------------


def decode_utf8(content: Column | str) -> Column:
    """Bytes to string; malformed bytes become U+FFFD and never fail the job."""
    return F.make_valid_utf8(_col(content).cast("string"))


def strip_http_headers(content: Column | str, version: str = "1.0") -> Column:
    """Page of a response body.

    Both versions cut after the line holding `Content-Length:`; version 1.0 then
    moves on to the first `<`, if there is one.
    """
    text = _col(content)
    header = F.position(F.lit("Content-Length:"), text)
    newline = F.position(F.lit("\n"), text, F.greatest(header, F.lit(1)))
    whole = F.length(text)
    after_line = F.substring(text, newline + 1, whole)
    if version == "0.18":
        return after_line
    if version != "1.0":
        raise ValueError(f"unknown WARC version: {version!r}")
    markup = F.position(F.lit("<"), text, F.greatest(newline, F.lit(1)))
    return F.when(markup > 0, F.substring(text, markup, whole)).otherwise(after_line)


# -- markup --------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def _visible_texts(pages: pa.Array) -> pa.Array:
    return visible_texts(pages)


def html_to_text(page: Column | str) -> Column:
    """Visible text of an HTML page, references decoded, whitespace normalised.

    Only pages that hold a `<` or a `&` go through Python.
    """
    page = _col(page)
    marked = F.contains(page, F.lit("<")) | F.contains(page, F.lit("&"))
    text = F.coalesce(_visible_texts(F.when(marked, page)), page)
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def collapse_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[\r\n]+", " ")


# -- analyzers -----------------------------------------------------------------


def word_tokens(text: Column | str) -> Column:
    """Lower-cased UAX #29 words of a text, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(patterns.token_pattern()), F.lit(0))


@dataclass(frozen=True)
class Analyzer:
    """A named token pipeline: words, stop list, and stemming for `porter`."""

    name: str
    stop_words: tuple[str, ...]
    stem: bool

    def tokens(self, text: Column | str) -> Column:
        stop = list(self.stop_words)

        def keep(token: Column) -> Column:
            # Bytes are known without counting characters, and are never fewer.
            short = (F.octet_length(token) <= MAX_TOKEN_CHARS) | (F.length(token) <= MAX_TOKEN_CHARS)
            return short & ~token.isin(stop) if stop else short

        kept = F.filter(word_tokens(text), keep)
        return stem_tokens(kept) if self.stem else kept


def get_analyzer(name: str | Analyzer, stop_words: Iterable[str] | None = None) -> Analyzer:
    """`standard` or `porter`; `stop_words` replaces the default list."""
    if isinstance(name, Analyzer):
        return name
    defaults = {"standard": ENGLISH_STOP_WORDS, "porter": FUNCTION_WORDS}
    if name not in defaults:
        raise ValueError(f"unknown analyzer {name!r}, expected standard|porter")
    words = defaults[name] if stop_words is None else stop_words
    return Analyzer(name, tuple(sorted({w.lower() for w in words})), name == "porter")


def read_stop_words(spark: SparkSession, path: str, limit: int = 100_000) -> list[str]:
    """One word per line; refuses a file that is too long to be a stop list."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''")
    words = [r.w for r in rows.limit(limit + 1).collect()]
    if len(words) > limit:
        raise ValueError(f"{path} has more than {limit} lines; not a stop list")
    return words
