"""Web archives made by Spark from the `pages` table, id lists and id mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators.docno import build_docno_mapping, lookup_docid, lookup_docno
from scanmill.operators.documents import corpus_health, count_records
from scanmill.operators.statistics import compute_term_statistics
from scanmill.runtime import scratch_path
from scanmill.sources.tables import read_docid_list
from scanmill.sources.warc import CUT_OFF, NO_LENGTH, read_warc, warc_docid, warc_documents
from suite import sql
from suite.base import pages, query, table


def page_archive(spark, sf_dir, version):
    """A gzipped archive: for each page a request without an id, and the response."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n"), "content")
    head = f"WARC/{version}\r\nWARC-Type: %s\r\n"
    ask = F.concat(
        F.lit(head % "request"), F.lit("Content-Length: 3\r\nno colon here\r\n\r\nGET\r\n")
    )
    answer = F.concat(
        F.lit(head % "response"),
        F.lit("WARC-TREC-ID: "),
        "docid",
        F.lit("\r\nContent-Type: application/http\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\nWARC-Date: 2012-02-10\r\n\r\n"),
        body,
        F.lit("\r\n"),
    )
    path = scratch_path(spark, "archive")
    records = pages(spark, sf_dir).select(F.explode(F.array(ask, answer)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\r\n").text(path)
    return f"{path}/*.gz"


_RESPONSE = """SELECT CAST(page_id AS VARCHAR) AS docid, 'response' AS warc_type, '2012-02-10' AS warc_date,
  CAST(octet_length(encode(html)) + 38 AS BIGINT) AS content_length, {content} AS content FROM pages"""


def _responses(records, version):
    kept = ("warc_type", "warc_date", "content_length")
    docs = warc_documents(records, version, kept).filter("docid IS NOT NULL")
    return docs.select("docid", *kept, "content")


@query("warc_scan_v10", "S1 P1 P2 D1", _RESPONSE.format(content="substr(html, strpos(html, '<'))"))
def _(spark, sf_dir):
    return _responses(read_warc(spark, page_archive(spark, sf_dir, "1.0"), "1.0"), "1.0")


@query("warc_scan_v018", "S2 P3", _RESPONSE.format(content="chr(13) || chr(10) || html"))
def _(spark, sf_dir):
    return _responses(read_warc(spark, page_archive(spark, sf_dir, "0.18"), "0.18"), "0.18")


@query(
    "warc_provenance",
    "S3",
    "SELECT 2 * count(*) AS records, 2 * count(*) AS positions, CAST(1 AS BIGINT) AS first_no, "
    "CAST(0 AS BIGINT) AS files_with_gaps FROM pages",
)
def _(spark, sf_dir):
    records = read_warc(spark, page_archive(spark, sf_dir, "1.0"), with_content=False)
    files = records.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("record_no").alias("distinct"),
        F.min("record_no").alias("first"),
        F.max("record_no").alias("last"),
    )
    return files.agg(
        F.sum("n").alias("records"),
        F.sum("distinct").alias("positions"),
        F.min("first").alias("first_no"),
        F.count_if(F.col("last") != F.col("n")).alias("files_with_gaps"),
    )


@query("count_records", "E1 A1", "SELECT 2 * count(*) AS total, count(*) AS pages FROM pages")
def _(spark, sf_dir):
    records = read_warc(spark, page_archive(spark, sf_dir, "1.0"), with_content=False)
    return count_records(records.withColumn("docid", warc_docid()))


def _damaged(spark, sf_dir):
    """An archive of all pages, each seventh without a usable length, and a file that is cut off."""
    docs = pages(spark, sf_dir)
    head = F.concat(F.lit("WARC/1.0\r\nWARC-TREC-ID: "), "docid", F.lit("\r\nContent-Length: "))
    size = F.octet_length("content")
    seventh = F.when(F.col("docid").cast("bigint") % 7 == 3, F.lit("unknown")).otherwise(size.cast("string"))
    path = scratch_path(spark, "damaged")
    for name, length, rows in (
        ("whole", seventh, docs),
        ("cut", (size + 100).cast("string"), docs.agg(F.max_by("docid", "content").alias("docid"), F.max("content").alias("content"))),
    ):
        record = F.concat(head, length, F.lit("\r\n\r\n"), "content", F.lit("\r\n"))
        writer = rows.select(record.alias("value")).write.option("lineSep", "\r\n")
        writer.option("compression", "gzip").text(f"{path}/{name}")
    return f"{path}/*/*.gz"


@query(
    "warc_damaged",
    "S1 F5 A10 E1",
    "SELECT count(*) + 1 AS total, count(*) + 1 AS pages, "
    "count(*) FILTER (page_id % 7 = 3) + 1 AS errors, CAST(0 AS BIGINT) AS too_long, "
    "count(*) FILTER (page_id % 7 = 3) AS no_length, CAST(1 AS BIGINT) AS cut_files FROM pages",
)
def _(spark, sf_dir):
    path = _damaged(spark, sf_dir)
    health = corpus_health(warc_documents(read_warc(spark, path)))
    damage = read_warc(spark, path, with_content=False).agg(
        F.count_if(F.col("damage") == NO_LENGTH).alias("no_length"),
        F.count_distinct(F.when(F.col("damage") == CUT_OFF, F.col("path"))).alias("cut_files"),
    )
    counted = damage.first()
    return health.select("*", *(F.lit(counted[n]).cast("bigint").alias(n) for n in ("no_length", "cut_files")))


@query(
    "warc_term_statistics",
    "E2 S1",
    sql.with_(
        sql.PAGES,
        sql.occurrences("occ", "docs", "docid", "porter"),
        sql.statistics(df_min=3),
        select="SELECT term, df, cf FROM stats",
    ),
)
def _(spark, sf_dir):
    records = read_warc(spark, page_archive(spark, sf_dir, "1.0"))
    return compute_term_statistics(warc_documents(records), "porter", df_min=3)


def _listed(spark, sf_dir):
    """A bz2 list with the source of each document as its id, so ids repeat."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.concat_ws(",", "source", "lang").alias("value")).union(
        docs.select(F.concat_ws(",", F.concat(F.lit("doc-"), F.col("doc_id")), "lang").alias("value"))
    )
    path = scratch_path(spark, "ids")
    lines.write.option("compression", "bzip2").text(path)
    return read_docid_list(spark, path)


_IDS = "ids AS (SELECT source AS docid FROM documents UNION ALL SELECT 'doc-' || doc_id FROM documents)"
_MAP = "map AS (SELECT row_number() OVER (ORDER BY docid) - 1 AS docno, docid FROM ids)"


@query("docid_list", "S8", sql.with_(_IDS, select="SELECT docid FROM ids"))
def _(spark, sf_dir):
    return _listed(spark, sf_dir)


@query("docno_mapping", "E14 W8", sql.with_(_IDS, _MAP, select="SELECT docno, docid FROM map"))
def _(spark, sf_dir):
    return build_docno_mapping(_listed(spark, sf_dir))


@query(
    "lookup_docno",
    "J7 E14",
    sql.with_(
        _IDS,
        _MAP,
        "asked AS (SELECT DISTINCT docid FROM ids UNION SELECT role FROM conversations)",
        "once AS (SELECT docid, min(docno) AS docno FROM map GROUP BY docid HAVING count(*) = 1)",
        select="SELECT docid, coalesce(docno, -1) AS docno FROM asked LEFT JOIN once USING (docid)",
    ),
)
def _(spark, sf_dir):
    ids = _listed(spark, sf_dir)
    asked = ids.union(table(spark, sf_dir, "conversations").select("role")).distinct()
    return lookup_docno(build_docno_mapping(ids), asked)


@query(
    "lookup_docid",
    "J7 E14",
    sql.with_(
        _IDS, _MAP, select="SELECT o_orderkey AS docno, docid FROM orders LEFT JOIN map ON docno = o_orderkey"
    ),
)
def _(spark, sf_dir):
    docnos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docno"))
    return lookup_docid(build_docno_mapping(_listed(spark, sf_dir)), docnos)
