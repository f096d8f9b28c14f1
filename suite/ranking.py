"""Query preparation and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions import scoring
from scanmill.operators import queries as Q
from scanmill.operators import ranking as R
from scanmill.operators.vectors import to_unique_vectors
from scanmill.runtime import resident, scratch_path, written
from scanmill.sinks.tables import write_doc_vectors
from scanmill.sinks.text import write_run
from scanmill.sources.tables import read_doc_vectors, read_queries, rejected_query_lines
from suite import sql
from suite.base import collection, dictionary, query, queries, table

K = 10
_STD = sql.corpus()
_POS = "pos AS (SELECT * FROM raw WHERE score > 0)"


def _inputs(spark, sf_dir, analyzer="standard"):
    """Vectors are a stored table by the time queries arrive."""
    flat, terms = collection(spark, sf_dir, analyzer)
    stored = written(flat, "vectors")
    return stored, terms, queries(spark, sf_dir)


_LINES = """SELECT item_id AS qid, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM benchmark"""


@query("query_file", "S7", _LINES)
def _(spark, sf_dir):
    """Each item as a `qid:words` line, among lines without a query number."""
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    good = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id"), F.lit(":"), text).alias("value"))
    bad = table(spark, sf_dir, "conversations").select(F.concat(F.col("role"), F.lit(": "), text).alias("value"))
    path = scratch_path(spark, "queries")
    good.union(bad).write.text(path)
    return read_queries(spark, path)


@query(
    "query_rejects",
    "S7 F5",
    r"""
    WITH l AS (
      SELECT CAST(role AS VARCHAR) || ': ' || regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM conversations
      UNION ALL SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') FROM documents
      UNION ALL SELECT '9' || lpad(CAST(item_id AS VARCHAR), 19, '0') || ': ' || regexp_replace(text, '[\r\n]+', ' ', 'g') FROM benchmark
    ), parts AS (SELECT line, regexp_extract(line, '^\s*(\d+)\s*:', 1) AS number FROM l)
    SELECT line, CASE WHEN number <> '' THEN 'number beyond 64 bits'
      WHEN contains(line, ':') THEN 'no number' ELSE 'no colon' END AS reason
    FROM parts WHERE trim(line) <> '' AND TRY_CAST(number AS BIGINT) IS NULL
    """,
)
def _(spark, sf_dir):
    """What a query file made of all texts holds besides queries."""
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    said = table(spark, sf_dir, "conversations").select(F.concat("role", F.lit(": "), text).alias("value"))
    plain = table(spark, sf_dir, "documents").select(text.alias("value"))
    number = F.concat(F.lit("9"), F.lpad(F.col("item_id").cast("string"), 19, "0"))
    large = table(spark, sf_dir, "benchmark").select(F.concat(number, F.lit(": "), text).alias("value"))
    path = scratch_path(spark, "queries")
    said.union(plain).union(large).write.text(path)
    return rejected_query_lines(spark.read.text(path))


@query(
    "prepared_queries",
    "R9 J3 F6",
    sql.with_(*_STD, select="SELECT qid, term, term_id, qtf, df, cf FROM qt"),
)
def _(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return Q.prepare_queries(queries(spark, sf_dir), terms, "standard")


@query(
    "query_idf",
    "R1",
    sql.with_(
        *_STD,
        select="SELECT qid, term_id, round(ln(((SELECT count(*) FROM vec) - df + 0.5) / (df + 0.5)), 6) AS idf FROM qt",
    ),
)
def _(spark, sf_dir):
    flat, terms, asked = _inputs(spark, sf_dir)
    n = Q.document_count(flat)
    prepared = Q.prepare_queries(asked, terms, "standard")
    return prepared.select("qid", "term_id", F.round(scoring.idf(F.col("df"), n), 6).alias("idf"))


def _bm25_sql(analyzer="standard", k=K, tie="docid", **params):
    corpus = sql.corpus(analyzer)
    return sql.with_(*corpus, sql.bm25(**params), _POS, select=sql.top_k("pos", k, "bm25", tie))


def _bm25(spark, sf_dir, unique=False, analyzer="standard", k=K, **options):
    flat, terms, asked = _inputs(spark, sf_dir, analyzer)
    docs = to_unique_vectors(flat) if unique else flat
    return R.bm25_topk(docs, terms, asked, k, analyzer, row_key=["docid"], **options)


@query("bm25_flat", "E12 R2 R3 J4 J5 A9 F7 W5 W6 W7 U2", _bm25_sql())
def _(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query("bm25_unique", "R5 J8", _bm25_sql())
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, unique=True)


@query("bm25_flat_stored", "R4 S5", _bm25_sql())
def _(spark, sf_dir):
    flat, terms, asked = _inputs(spark, sf_dir)
    path = scratch_path(spark, "flat")
    write_doc_vectors(flat, path, partitions=4)
    return R.bm25_topk(read_doc_vectors(spark, path), terms, asked, K, "standard")


@query("bm25_unique_stored", "R6 S5", _bm25_sql())
def _(spark, sf_dir):
    flat, terms, asked = _inputs(spark, sf_dir)
    path = scratch_path(spark, "unique")
    write_doc_vectors(to_unique_vectors(flat), path, partitions=4)
    return R.bm25_topk(read_doc_vectors(spark, path, unique=True), terms, asked, K, "standard")


@query("bm25_cached", "U3", _bm25_sql())
def _(spark, sf_dir):
    flat, terms, asked = _inputs(spark, sf_dir)
    with resident(to_unique_vectors(flat)) as kept:
        return written(R.bm25_topk(kept, terms, asked, K, "standard"), "run")


@query("bm25_porter", "E12 R9 P7", _bm25_sql("porter"))
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, analyzer="porter")


@query("bm25_measured_length", "R2", _bm25_sql(average="avgdl", k1=1.2, b=0.75))
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, average_length=None, k1=1.2, b=0.75)


@query("bm25_ties_by_docid_desc", "W4", _bm25_sql(tie="docid DESC"))
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, tie="docid_desc")


@query("bm25_deep", "W5 W6", _bm25_sql(k=1500))
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, k=1500)


@query("bm25_deep_cut", "W5 W6 W7", _bm25_sql(k=100))
def _(spark, sf_dir):
    """The way for a large k, with a k that does cut."""
    return _bm25(spark, sf_dir, k=100, deep_beyond=50)


_ALL = """allraw AS (
  SELECT q.qid, vec.docid, coalesce(raw.score, 0.0) AS score
  FROM q CROSS JOIN vec LEFT JOIN raw ON raw.qid = q.qid AND raw.docid = vec.docid
)"""


@query(
    "bm25_all_documents",
    "F7",
    sql.with_(*_STD, sql.bm25(), _ALL, select=sql.top_k("allraw", 900, "bm25")),
)
def _(spark, sf_dir):
    return _bm25(spark, sf_dir, k=900, positive_only=False)


@query(
    "run_file",
    "K6",
    "SELECT qid || ' Q0 ' || docid || ' ' || rank || ' ' || CAST(CAST(score AS DECIMAL(18, 6)) AS VARCHAR) "
    f"|| ' ' || tag AS line FROM ({_bm25_sql()})",
)
def _(spark, sf_dir):
    """The lines as written, with scores of six digits."""
    path = scratch_path(spark, "run")
    write_run(_bm25(spark, sf_dir), path)
    fields = F.split("value", " ")
    score = F.get(fields, F.lit(4)).cast("double").cast("decimal(18,6)").cast("string")
    kept = [score if i == 4 else F.get(fields, F.lit(i)) for i in range(6)]
    return spark.read.text(path).select(F.concat_ws(" ", *kept).alias("line"))


def _lm_sql(smoothing, background="df", analyzer="standard"):
    return sql.with_(
        *sql.corpus(analyzer),
        sql.likelihood(smoothing, background),
        select=sql.top_k("raw", K, "lmretrieval"),
    )


def _lm(spark, sf_dir, smoothing, analyzer="standard", unique=False, **options):
    flat, terms, asked = _inputs(spark, sf_dir, analyzer)
    docs = to_unique_vectors(flat) if unique else flat
    return R.lm_topk(docs, terms, asked, K, smoothing, analyzer, row_key=["docid"], **options)


@query("lm_dirichlet", "E13 R8 A9", _lm_sql(1000.0))
def _(spark, sf_dir):
    return _lm(spark, sf_dir, 1000.0)


@query("lm_dirichlet_porter", "E13 R8 P7", _lm_sql(1000.0, analyzer="porter"))
def _(spark, sf_dir):
    return _lm(spark, sf_dir, 1000.0, analyzer="porter", unique=True)


@query("lm_jelinek_mercer", "R7", _lm_sql(0.4))
def _(spark, sf_dir):
    return _lm(spark, sf_dir, 0.4)


@query("lm_cf_background", "R8", _lm_sql(500.0, "cf"))
def _(spark, sf_dir):
    return _lm(spark, sf_dir, 500.0, background="cf", unique=True)


@query("lm_without_background", "R7", _lm_sql(1.0))
def _(spark, sf_dir):
    return _lm(spark, sf_dir, 1.0)


@query(
    "candidate_terms",
    "J6 F8",
    sql.materialised(
        sql.with_(
            *_STD,
            sql.likelihood(1000.0, "df"),
            f"run AS ({sql.top_k('raw', K, 'lmretrieval')})",
            "wanted AS (SELECT run.qid, run.docid, run.rank, qt.term_id FROM run JOIN qt USING (qid))",
            "held AS (SELECT docid, term_id, tf FROM post WHERE docid IN (SELECT docid FROM run))",
            select="SELECT qid, docid, rank, term_id, CAST(coalesce(tf, 0) AS INTEGER) AS tf "
            "FROM wanted LEFT JOIN held USING (docid, term_id)",
        )
    ),
)
def _(spark, sf_dir):
    """The words behind each row of a ranked run."""
    flat, terms, asked = _inputs(spark, sf_dir)
    run = R.lm_topk(flat, terms, asked, K, 1000.0, "standard", row_key=["docid"])
    return R.candidate_terms(written(run, "run"), flat, Q.prepare_queries(asked, terms, "standard"))


@query(
    "matching_pairs",
    "J4 J8",
    sql.with_(*_STD, select="SELECT qid, docid, term_id, tf FROM post JOIN qt USING (term_id)"),
)
def _(spark, sf_dir):
    flat, terms, asked = _inputs(spark, sf_dir)
    prepared = Q.prepare_queries(asked, terms, "standard")
    return R.matching_pairs(to_unique_vectors(flat), prepared, ["docid"])
