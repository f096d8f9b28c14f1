"""Text scalars, document filters and dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions.text import (
    collapse_newlines,
    get_analyzer,
    html_to_text,
    strip_http_headers,
)
from scanmill.operators.documents import corpus_health, observe_health, with_docid, with_status
from scanmill.operators.dumps import dump_plain_text, dump_term_ids
from scanmill.runtime import scratch_path
from scanmill.sinks.text import plain_text_lines, term_id_lines, write_lines
from suite import sql
from suite.base import dictionary, documents, pages, query, table


def _bodies(spark, sf_dir):
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n")
    return pages(spark, sf_dir).withColumn("body", F.concat(head, "content"))


@query(
    "strip_http_headers_v10",
    "P2",
    "SELECT CAST(page_id AS VARCHAR) AS docid, substr(html, strpos(html, '<')) AS content FROM pages",
)
def _(spark, sf_dir):
    return _bodies(spark, sf_dir).select("docid", strip_http_headers("body", "1.0").alias("content"))


@query(
    "strip_http_headers_v018",
    "P3",
    "SELECT CAST(page_id AS VARCHAR) AS docid, chr(13) || chr(10) || html AS content FROM pages",
)
def _(spark, sf_dir):
    return _bodies(spark, sf_dir).select("docid", strip_http_headers("body", "0.18").alias("content"))


@query(
    "html_to_text",
    "P4",
    f"SELECT CAST(page_id AS VARCHAR) AS docid, {sql.html_text('html')} AS text FROM pages",
)
def _(spark, sf_dir):
    return pages(spark, sf_dir).select("docid", html_to_text("content").alias("text"))


@query(
    "collapse_newlines",
    "P5",
    r"SELECT conv_id, turn, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM conversations",
)
def _(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return conversations.select("conv_id", "turn", collapse_newlines("text").alias("text"))


def _analyzed(analyzer):
    occ = sql.occurrences("occ", "docs", "docid", analyzer)
    joined = "SELECT docid, string_agg(term, '|' ORDER BY pos) AS tokens FROM occ GROUP BY docid"
    select = f"SELECT docid, coalesce(tokens, '') AS tokens FROM docs LEFT JOIN ({joined}) USING (docid)"
    return sql.with_(sql.DOCS, occ, select=select)


@query("analyzer_standard", "P6", _analyzed("standard"))
def _(spark, sf_dir):
    tokens = get_analyzer("standard").tokens("content")
    return documents(spark, sf_dir).select("docid", F.array_join(tokens, "|").alias("tokens"))


@query("analyzer_porter", "P7", _analyzed("porter"))
def _(spark, sf_dir):
    tokens = get_analyzer("porter").tokens("content")
    return documents(spark, sf_dir).select("docid", F.array_join(tokens, "|").alias("tokens"))


_TURNS = "t AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)"


@query(
    "analyzer_by_name",
    "P8",
    sql.with_(
        _TURNS,
        sql.occurrences("a", "t", "turn_id", "standard", "text"),
        sql.occurrences("b", "t", "turn_id", "porter", "text"),
        select="SELECT 'standard' AS analyzer, count(*) AS tokens, count(DISTINCT term) AS terms FROM a "
        "UNION ALL SELECT 'porter', count(*), count(DISTINCT term) FROM b",
    ),
)
def _(spark, sf_dir):
    text = table(spark, sf_dir, "conversations").select("text")

    def counted(name):
        tokens = text.select(F.explode_outer(get_analyzer(name).tokens("text")).alias("term"))
        return tokens.agg(F.count("term").alias("tokens"), F.countDistinct("term").alias("terms")).select(
            F.lit(name).alias("analyzer"), "tokens", "terms"
        )

    return counted("standard").unionByName(counted("porter"))


# A corpus in which some records lack an id, some lack content and some are too long:
# turns, of which only the assistant's have an id, and those with a `q` have no
# readable content.
_RECORDS = """docs AS (SELECT
  CASE WHEN role = 'assistant' THEN conv_id || '-' || turn END AS docid,
  CASE WHEN NOT contains(text, 'q') THEN text END AS content
FROM conversations)"""
_LIMIT = 500


def _records(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    docid = F.when(F.col("role") == "assistant", F.concat_ws("-", "conv_id", "turn"))
    content = F.when(~F.contains("text", F.lit("q")), F.col("text"))
    return turns.select(docid.alias("docid"), content.alias("content"))


_STATUS = f"""CASE WHEN docid IS NULL THEN 'no_docid' WHEN content IS NULL THEN 'error'
  WHEN length(content) > {_LIMIT} THEN 'too_long' ELSE 'ok' END"""


@query(
    "document_status",
    "F2 F5",
    sql.with_(_RECORDS, select=f"SELECT docid, length(content) AS chars, {_STATUS} AS status FROM docs"),
)
def _(spark, sf_dir):
    marked = with_status(_records(spark, sf_dir), _LIMIT)
    return marked.select("docid", F.length("content").cast("bigint").alias("chars"), "status")


@query("has_docid", "F1", sql.with_(_RECORDS, select="SELECT docid, content FROM docs WHERE docid IS NOT NULL"))
def _(spark, sf_dir):
    return with_docid(_records(spark, sf_dir))


_HEALTH = sql.with_(
    _RECORDS,
    select=f"""SELECT count(*) AS total, count(docid) AS pages,
  count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'too_long') AS too_long
FROM (SELECT docid, {_STATUS} AS status FROM docs)""",
)


@query("corpus_health", "A10", _HEALTH)
def _(spark, sf_dir):
    return corpus_health(_records(spark, sf_dir), _LIMIT)


@query("corpus_health_in_flight", "A10", _HEALTH)
def _(spark, sf_dir):
    marked, seen = observe_health(_records(spark, sf_dir), "in_flight", _LIMIT)
    marked.write.parquet(scratch_path(spark, "marked"))
    counts = seen.get
    names = ("total", "pages", "errors", "too_long")
    return spark.range(1).select(*[F.lit(counts[n]).cast("bigint").alias(n) for n in names])


_PLAIN = sql.with_(
    sql.DOCS,
    sql.occurrences("occ", "docs", "docid"),
    select="SELECT docid || chr(9) || coalesce(t, '') AS value FROM docs LEFT JOIN "
    "(SELECT docid, string_agg(term, '|' ORDER BY pos) AS t FROM occ GROUP BY docid) USING (docid)",
)


@query("plain_text_dump", "E9 K4", _PLAIN)
def _(spark, sf_dir):
    path = scratch_path(spark, "plain")
    write_lines(plain_text_lines(dump_plain_text(documents(spark, sf_dir), html=False)), path)
    return spark.read.text(path)


@query(
    "plain_text_dump_pages",
    "E9",
    sql.with_(
        sql.PAGES,
        sql.occurrences("occ", "docs", "docid"),
        select="SELECT docid, coalesce(t, '') AS text FROM docs LEFT JOIN "
        "(SELECT docid, string_agg(term, '|' ORDER BY pos) AS t FROM occ GROUP BY docid) USING (docid)",
    ),
)
def _(spark, sf_dir):
    return dump_plain_text(pages(spark, sf_dir))


@query(
    "term_id_dump",
    "E10 K5",
    sql.with_(
        *sql.corpus()[:5],
        select="SELECT docid || chr(9) || '[' || array_to_string(term_ids, ', ') || ']' AS value FROM vec",
    ),
)
def _(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    dump = dump_term_ids(documents(spark, sf_dir), terms, html=False, row_key=["docid"])
    path = scratch_path(spark, "ids")
    write_lines(term_id_lines(dump), path, partitions=4)
    return spark.read.text(path)


@query(
    "term_id_dump_unusable",
    "E10 F5",
    sql.with_(
        _RECORDS.replace("docs AS", "recs AS"),
        sql.DOCS,
        sql.occurrences("occ", "docs", "docid"),
        sql.statistics(),
        sql.DICTIONARY,
        sql.occurrences("rocc", "recs", "docid"),
        select=f"""SELECT docid, CASE WHEN {_STATUS} = 'ok' THEN '[' || coalesce(ids, '') || ']' ELSE '' END AS ids
FROM recs LEFT JOIN (
  SELECT docid, string_agg(CAST(term_id AS VARCHAR), ', ' ORDER BY pos) AS ids
  FROM rocc JOIN dict USING (term) WHERE docid IS NOT NULL GROUP BY docid
) USING (docid) WHERE docid IS NOT NULL""",
    ),
)
def _(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return dump_term_ids(
        _records(spark, sf_dir), terms, html=False, max_chars=_LIMIT, row_key=["docid"]
    )
