"""Term dictionary: terms numbered 1..V by falling df, with df and cf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.operators.numbering import dense_ids
from scanmill.runtime import written


def build_dictionary(stats: DataFrame, expected_count: int | None = None) -> DataFrame:
    """(term_id, term, df, cf); ids by df descending, then term ascending.

    Raises when a term has more than one row, or the number of terms is not the
    expected one.
    """
    numbered = dense_ids(
        stats.select("term", "df", "cf"), [F.col("df").desc(), F.col("term").asc()], "term_id"
    )
    term_id = F.col("term_id").cast("int").alias("term_id")
    dictionary = written(numbered.select(term_id, "term", "df", "cf"), "dictionary")
    check_dictionary(dictionary, expected_count)
    return dictionary


def repeated_terms(stats: DataFrame) -> DataFrame:
    """(term, rows) of the terms that are not unique."""
    return stats.groupBy("term").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_dictionary(dictionary: DataFrame, expected_count: int | None = None) -> None:
    twice = repeated_terms(dictionary).first()
    if twice is not None:
        raise ValueError(f"term {twice.term!r} has {twice.rows} rows")
    if expected_count is not None:
        found = dictionary.count()
        if found != expected_count:
            raise ValueError(f"expected {expected_count} terms, found {found}")


ORDERS = ("utf8", "utf16")


def term_order(order: str = "utf8") -> Column:
    """Sort key of `term`: by bytes, so by code points, or by UTF-16 code units.

    They differ for characters beyond the basic plane: by code units, these come before
    U+E000 to U+FFFF.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}, expected one of {ORDERS}")
    return F.col("term") if order == "utf8" else F.encode(F.col("term"), "UTF-16BE")


def with_lexicographic_position(dictionary: DataFrame, order: str = "utf8") -> DataFrame:
    """Add `lex_pos`, the 0-based position of a term in sorted order."""
    keyed = dictionary.withColumn("_order", term_order(order))
    return dense_ids(keyed, [F.col("_order").asc()], "lex_pos", start=0).drop("_order")


def lookup_terms(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """Ids, df and cf of `terms.term`; unknown terms get id -1 and zero counts."""
    return terms.join(dictionary, "term", "left").select(
        "term",
        F.coalesce("term_id", F.lit(-1)).alias("term_id"),
        F.coalesce("df", F.lit(0)).alias("df"),
        F.coalesce("cf", F.lit(0)).alias("cf"),
    )


def lookup_term_ids(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """Terms, df and cf of `ids.term_id`; ids out of range get a null term."""
    return ids.join(dictionary, "term_id", "left").select(
        "term_id",
        "term",
        F.coalesce("df", F.lit(0)).alias("df"),
        F.coalesce("cf", F.lit(0)).alias("cf"),
    )


def dictionary_summary(dictionary: DataFrame) -> DataFrame:
    """One row: vocabulary and collection size, top df and cf with their lowest term id."""
    return dictionary.agg(
        F.count(F.lit(1)).alias("vocabulary_size"),
        F.sum("cf").alias("collection_size"),
        F.max("df").alias("max_df"),
        F.min_by("term_id", F.struct(-F.col("df"), F.col("term_id"))).alias("max_df_term_id"),
        F.max("cf").alias("max_cf"),
        F.min_by("term_id", F.struct(-F.col("cf"), F.col("term_id"))).alias("max_cf_term_id"),
    )
