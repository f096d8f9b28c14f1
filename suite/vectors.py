"""Document vectors: build, compact, decode, make unique."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.documents import analyzed
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import build_doc_vectors, decode_doc_vectors, postings, to_unique_vectors
from scanmill.runtime import scratch_path
from scanmill.sinks.tables import write_doc_vectors
from scanmill.sources.tables import read_doc_vectors
from suite import sql
from suite.base import collection, pages, query

_VEC = sql.corpus()[:5]
_FLAT = "SELECT docid, array_to_string(term_ids, ' ') AS ids, doc_len FROM vec"


def _shown(flat):
    ids = F.array_join(F.col("term_ids").cast("array<string>"), " ")
    return flat.select("docid", ids.alias("ids"), "doc_len")


def _built(spark, sf_dir, analyzer="standard", **options):
    return collection(spark, sf_dir, analyzer, **options)


@query("doc_vectors", "E7 P9 J1 P12", sql.with_(*_VEC, select=_FLAT))
def _(spark, sf_dir):
    return _shown(_built(spark, sf_dir)[0])


@query("doc_vectors_porter", "E7 P7", sql.with_(*sql.corpus("porter")[:5], select=_FLAT))
def _(spark, sf_dir):
    return _shown(_built(spark, sf_dir, "porter")[0])


@query("doc_vectors_large_dictionary", "J1", sql.with_(*_VEC, select=_FLAT))
def _(spark, sf_dir):
    """Only the most frequent terms are broadcast, the others are shuffle-joined."""
    return _shown(_built(spark, sf_dir, broadcast_terms=1000)[0])


@query(
    "doc_vectors_pages",
    "E7 P4",
    sql.with_(*sql.corpus(docs=sql.PAGES, df_min=1)[:5], select=_FLAT),
)
def _(spark, sf_dir):
    docs = analyzed(pages(spark, sf_dir), "standard")
    terms = build_dictionary(compute_term_statistics(docs, "standard", df_min=1))
    return _shown(build_doc_vectors(docs, terms, "standard", row_key=["docid"]))


@query("doc_vectors_compacted", "K3 S5 U4", sql.with_(*_VEC, select=_FLAT))
def _(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    write_doc_vectors(_built(spark, sf_dir)[0], path, partitions=4)
    return _shown(read_doc_vectors(spark, path))


_DECODED = sql.with_(
    *_VEC,
    select="""SELECT docid, coalesce(terms, '') AS terms FROM docs LEFT JOIN (
  SELECT docid, string_agg(term, '|' ORDER BY pos) AS terms FROM occ JOIN dict USING (term) GROUP BY docid
) USING (docid)""",
)


@query("decode_doc_vectors", "E8 P10 J2", _DECODED)
def _(spark, sf_dir):
    flat, terms = _built(spark, sf_dir)
    decoded = decode_doc_vectors(flat, terms, row_key=["docid"])
    return decoded.select("docid", F.array_join("terms", "|").alias("terms"))


@query("decode_large_dictionary", "J2", _DECODED)
def _(spark, sf_dir):
    flat, terms = _built(spark, sf_dir)
    decoded = decode_doc_vectors(flat, terms, row_key=["docid"], broadcast_terms=1000)
    return decoded.select("docid", F.array_join("terms", "|").alias("terms"))


@query(
    "unique_vectors",
    "E11 P11",
    sql.with_(
        *_VEC,
        sql.POSTINGS,
        select="""SELECT vec.docid, coalesce(terms, '') AS terms, vec.doc_len FROM vec LEFT JOIN (
  SELECT docid, string_agg(term_id || ':' || tf, ' ' ORDER BY term_id) AS terms FROM post GROUP BY docid
) p ON p.docid = vec.docid""",
    ),
)
def _(spark, sf_dir):
    unique = to_unique_vectors(_built(spark, sf_dir)[0])
    pairs = F.transform("terms", lambda t: F.concat_ws(":", t["term_id"], t["tf"]))
    return unique.select("docid", F.array_join(pairs, " ").alias("terms"), "doc_len")


@query(
    "postings",
    "P11",
    sql.with_(*_VEC, sql.POSTINGS, select="SELECT docid, doc_len, term_id, tf FROM post"),
)
def _(spark, sf_dir):
    entries, _ = postings(_built(spark, sf_dir)[0], ["docid"])
    return entries


@query("document_count", "A8", "SELECT count(*) AS n FROM documents")
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].agg(F.count(F.lit(1)).alias("n"))


@query(
    "encoded_terms",
    "A10",
    sql.with_(*_VEC, select="SELECT CAST(sum(doc_len) AS BIGINT) AS terms FROM vec"),
)
def _(spark, sf_dir):
    return _built(spark, sf_dir)[0].agg(F.sum("doc_len").alias("terms"))
