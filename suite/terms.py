"""Term statistics, merging, dictionary and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators import dictionary as D
from scanmill.operators.numbering import dense_ids
from scanmill.operators.statistics import (
    compute_term_statistics,
    in_df_range,
    merge_replacing,
    merge_term_statistics,
    term_frequencies,
)
from scanmill.runtime import scratch_path, written
from scanmill.sinks.tables import write_dictionary, write_segments, write_sorted, write_term_statistics
from scanmill.sources.tables import (
    TERM_STATISTICS,
    read_dictionary,
    read_documents,
    read_keys,
    read_segments,
    read_term_statistics,
)
from suite import sql
from suite.base import DF_MIN, dictionary, documents, pages, query, statistics, table

_OCC = (sql.DOCS, sql.occurrences("occ", "docs", "docid"))
_STATS = (*_OCC, sql.statistics(df_min=DF_MIN))
_DICT = (*_STATS, sql.DICTIONARY)


@query(
    "term_frequencies",
    "A2",
    sql.with_(*_OCC, select="SELECT docid, term, count(*) AS tf FROM occ GROUP BY docid, term"),
)
def _(spark, sf_dir):
    return term_frequencies(documents(spark, sf_dir), "standard", html=False)


@query("term_statistics", "E2 A3 F4", sql.with_(*_STATS, select="SELECT term, df, cf FROM stats"))
def _(spark, sf_dir):
    return statistics(spark, sf_dir)


@query(
    "term_statistics_porter",
    "E2 P7",
    sql.with_(
        sql.DOCS,
        sql.occurrences("occ", "docs", "docid", "porter"),
        sql.statistics(df_min=DF_MIN),
        select="SELECT term, df, cf FROM stats",
    ),
)
def _(spark, sf_dir):
    return statistics(spark, sf_dir, "porter")


@query(
    "term_statistics_pages",
    "E2 P4",
    sql.with_(
        sql.PAGES,
        sql.occurrences("occ", "docs", "docid"),
        sql.statistics(df_min=1),
        select="SELECT term, df, cf FROM stats",
    ),
)
def _(spark, sf_dir):
    return compute_term_statistics(pages(spark, sf_dir), "standard", df_min=1)


@query(
    "term_length_cap",
    "F3",
    sql.with_(*_OCC, sql.statistics(df_min=1, max_chars=6), select="SELECT term, df, cf FROM stats"),
)
def _(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return compute_term_statistics(docs, "standard", 1, html=False, max_term_chars=6)


@query(
    "df_range",
    "F4",
    sql.with_(*_STATS, select="SELECT term, df, cf FROM stats WHERE df BETWEEN 5 AND 20"),
)
def _(spark, sf_dir):
    return in_df_range(statistics(spark, sf_dir), 5, 20)


_SEGMENTS = (
    *_OCC,
    """seg AS (
  SELECT lang, term, CAST(count(DISTINCT docid) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf
  FROM occ JOIN docs USING (docid) WHERE length(term) <= 64
  GROUP BY lang, term HAVING count(DISTINCT docid) >= 2
)""",
)


def _segments(spark, sf_dir):
    """Statistics of each language's documents, with a threshold of their own."""
    return compute_term_statistics(documents(spark, sf_dir, "lang"), "standard", 2, html=False, by=("lang",))


_MERGED = sql.with_(
    *_SEGMENTS,
    select="SELECT term, CAST(sum(df) AS BIGINT) AS df, CAST(sum(cf) AS BIGINT) AS cf "
    "FROM seg GROUP BY term HAVING sum(df) >= 4",
)


@query("merge_term_statistics", "E3 A4 U1", _MERGED)
def _(spark, sf_dir):
    return merge_term_statistics(_segments(spark, sf_dir).drop("lang"), df_min=4)


@query("merge_written_statistics", "S4 K1 U1", _MERGED)
def _(spark, sf_dir):
    base = scratch_path(spark, "segments")
    segments = written(_segments(spark, sf_dir), "segments")
    write_term_statistics(segments.filter("lang < 'e'"), f"{base}/disk0")
    write_term_statistics(segments.filter("lang >= 'e'"), f"{base}/disk1")
    return merge_term_statistics(read_term_statistics(spark, f"{base}/disk*"), df_min=4)


@query(
    "repeated_terms",
    "A5",
    sql.with_(*_SEGMENTS, select="SELECT term, count(*) AS rows FROM seg GROUP BY term HAVING count(*) > 1"),
)
def _(spark, sf_dir):
    return D.repeated_terms(_segments(spark, sf_dir))


@query(
    "segment_pruning",
    "U5",
    sql.with_(
        _OCC[0].replace("FROM documents", "FROM documents WHERE lang = 'de'"),
        _OCC[1],
        sql.statistics(df_min=1),
        select="SELECT term, df, cf FROM stats",
    ),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    table(spark, sf_dir, "documents").write.partitionBy("lang").parquet(path)
    docs = read_documents(spark, path, "doc_id", "text", segment="lang = 'de'")
    return compute_term_statistics(docs, "standard", 1, html=False)


_REPLACED = sql.with_(
    *_OCC,
    """new AS (
  SELECT term, CAST(count(DISTINCT docid) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM occ
  JOIN docs USING (docid)
  WHERE length(term) <= 64 AND (lang IS DISTINCT FROM 'de' OR CAST(docid AS BIGINT) % 2 = 0) AND lang IS NOT NULL
  GROUP BY term
)""",
    select="SELECT term, df, cf FROM new",
)


def _replaced(spark, sf_dir):
    """Segments by language, one of them counted anew over half its documents; (folder, merged totals)."""
    path = scratch_path(spark, "segments")
    docs = documents(spark, sf_dir, "lang").filter("lang is not null")
    by_lang = compute_term_statistics(docs, "standard", 1, html=False, by=("lang",))
    write_segments(by_lang.withColumnRenamed("lang", "segment"), path)
    merged = written(merge_term_statistics(read_segments(spark, path, TERM_STATISTICS), df_min=1), "merged")
    half = docs.filter("lang = 'de' and cast(docid as bigint) % 2 = 0")
    new = written(compute_term_statistics(half, "standard", 1, html=False), "segment")
    totals = written(merge_replacing(merged, read_segments(spark, path, TERM_STATISTICS, "de"), new), "totals")
    write_segments(new.withColumn("segment", F.lit("de")), path)
    return path, totals


@query("segment_replaced_totals", "U5 A4 E3", _REPLACED)
def _(spark, sf_dir):
    return _replaced(spark, sf_dir)[1]


@query("segment_replaced_merge", "U5 S4 K1 E3", _REPLACED)
def _(spark, sf_dir):
    path, _ = _replaced(spark, sf_dir)
    return merge_term_statistics(read_segments(spark, path, TERM_STATISTICS), df_min=1)


@query("dictionary", "E4 W1", sql.with_(*_DICT, select="SELECT term_id, term, df, cf FROM dict"))
def _(spark, sf_dir):
    return dictionary(spark, sf_dir)


@query("dictionary_written", "K2 S6", sql.with_(*_DICT, select="SELECT term_id, term, df, cf FROM dict"))
def _(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    write_dictionary(dictionary(spark, sf_dir), path)
    return read_dictionary(spark, path)


_LEX = "SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS lex_pos, term_id, term FROM dict"


@query("lexicographic_positions", "W3", sql.with_(*_DICT, select=_LEX))
def _(spark, sf_dir):
    placed = D.with_lexicographic_position(dictionary(spark, sf_dir))
    return placed.select("lex_pos", "term_id", "term")


@query(
    "lexicographic_order",
    "W2",
    sql.with_(*_OCC, select="SELECT term, row_number() OVER (ORDER BY term) AS pos FROM (SELECT DISTINCT term FROM occ)"),
)
def _(spark, sf_dir):
    terms = term_frequencies(documents(spark, sf_dir), "standard", html=False).select("term").distinct()
    return dense_ids(terms, [F.col("term").asc()], "pos")


# Letters beyond the basic plane, and at its end: the two orders put these the other way round.
_BEYOND, _AT_THE_END = "\U0001d4b6", "\ufb01"


@query(
    "lexicographic_order_utf16",
    "W2 W3",
    sql.with_(
        *_DICT,
        f"moved AS (SELECT term_id, translate(term, 'en', '{_BEYOND}{_AT_THE_END}') AS term FROM dict)",
        """keyed AS (
  SELECT term_id, term, array_to_string(list_transform(string_split(term, ''), lambda c: CASE
    WHEN unicode(c) < 65536 THEN printf('%04x', unicode(c))
    ELSE printf('%04x%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '') AS units
  FROM moved
)""",
        select="SELECT CAST(row_number() OVER (ORDER BY units, term_id) - 1 AS BIGINT) AS lex_pos, term_id, term FROM keyed "
        "WHERE term IN (SELECT term FROM moved GROUP BY term HAVING count(*) = 1)",
    ),
)
def _(spark, sf_dir):
    """Terms with some letters exchanged for ones on which the orders differ."""
    terms = dictionary(spark, sf_dir)
    moved = written(terms.select("term_id", F.translate("term", "en", _BEYOND + _AT_THE_END).alias("term")), "moved")
    placed = D.with_lexicographic_position(moved, order="utf16")
    return placed.select("lex_pos", "term_id", "term")


@query(
    "lookup_terms",
    "E5",
    sql.with_(
        *_DICT,
        "asked AS (SELECT DISTINCT role AS term FROM conversations UNION SELECT term FROM dict)",
        select="SELECT term, coalesce(term_id, -1) AS term_id, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf "
        "FROM asked LEFT JOIN dict USING (term)",
    ),
)
def _(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    roles = table(spark, sf_dir, "conversations").select(F.col("role").alias("term"))
    return D.lookup_terms(terms, roles.union(terms.select("term")).distinct())


@query(
    "lookup_stored_terms",
    "E5 W3",
    sql.with_(
        *_DICT,
        "asked AS (SELECT DISTINCT role AS term FROM conversations UNION SELECT DISTINCT lang FROM documents)",
        select="SELECT term, coalesce(term_id, -1) AS term_id, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf "
        "FROM asked LEFT JOIN dict USING (term) WHERE term IS NOT NULL",
    ),
)
def _(spark, sf_dir):
    """A few terms, in a copy of the dictionary in their order, by pushed filters."""
    path = scratch_path(spark, "by-term")
    write_sorted(dictionary(spark, sf_dir), path, "term")
    roles = table(spark, sf_dir, "conversations").select(F.col("role").alias("term"))
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("term"))
    asked = written(roles.union(langs).distinct().filter("term is not null"), "asked")
    found = read_keys(read_dictionary(spark, path), "term", [r.term for r in asked.collect()])
    return D.lookup_terms(found, asked)


@query(
    "lookup_term_ids",
    "E5",
    sql.with_(
        *_DICT,
        "asked AS (SELECT CAST(o_orderkey AS INTEGER) AS term_id FROM orders)",
        select="SELECT term_id, term, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf "
        "FROM asked LEFT JOIN dict USING (term_id)",
    ),
)
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("term_id"))
    return D.lookup_term_ids(dictionary(spark, sf_dir), ids)


@query(
    "dictionary_summary",
    "E6 A6 A7",
    sql.with_(
        *_DICT,
        select="""SELECT count(*) AS vocabulary_size, CAST(sum(cf) AS BIGINT) AS collection_size,
  max(df) AS max_df, (SELECT term_id FROM dict ORDER BY df DESC, term_id LIMIT 1) AS max_df_term_id,
  max(cf) AS max_cf, (SELECT term_id FROM dict ORDER BY cf DESC, term_id LIMIT 1) AS max_cf_term_id FROM dict""",
    ),
)
def _(spark, sf_dir):
    return D.dictionary_summary(dictionary(spark, sf_dir))
