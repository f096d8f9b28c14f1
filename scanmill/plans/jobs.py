"""The batch jobs, each from paths to paths.

Every job reads files, composes operators, and writes one output; what one job
writes is what the next one reads, so lineage ends between jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.text import Analyzer
from scanmill.operators import dumps, ranking
from scanmill.operators.dictionary import build_dictionary, dictionary_summary
from scanmill.operators.docno import build_docno_mapping
from scanmill.operators.documents import count_records, observe_health
from scanmill.operators.statistics import (
    DEFAULT_DF_MIN,
    compute_term_statistics,
    merge_replacing,
    merge_term_statistics,
)
from scanmill.operators.vectors import build_doc_vectors, decode_doc_vectors, to_unique_vectors
from scanmill.runtime import resident, written
from scanmill.sinks import tables as sinks
from scanmill.sinks import text as lines
from scanmill.sources import tables as sources
from scanmill.sources.warc import read_warc, warc_docid, warc_documents

# A record's place in its file tells records apart even if they share a docid.
_WARC_KEY = ["path", "record_no"]


def warc_pages(spark: SparkSession, warc: str | list[str], version: str = "1.0") -> DataFrame:
    return warc_documents(read_warc(spark, warc, version), version)


def _observed(spark: SparkSession, warc: str | list[str], version: str) -> tuple[DataFrame, Observation]:
    """Pages, and their counters once a job has read them."""
    pages, seen = observe_health(warc_pages(spark, warc, version), "pages")
    return pages.drop("status"), seen


def count_warc_records(spark: SparkSession, warc: str | list[str], version: str = "1.0") -> DataFrame:
    """One row (total, pages); bodies are skipped, not read into Spark."""
    records = read_warc(spark, warc, version, with_content=False)
    return count_records(records.withColumn("docid", warc_docid()))


def term_statistics(
    spark: SparkSession,
    warc: str | list[str],
    output: str,
    analyzer: str | Analyzer,
    version: str = "1.0",
    df_min: int = DEFAULT_DF_MIN,
    df_max: int | None = None,
) -> dict[str, int]:
    """Writes statistics; returns the counters of the pages read."""
    pages, seen = _observed(spark, warc, version)
    sinks.write_term_statistics(compute_term_statistics(pages, analyzer, df_min, df_max), output)
    return seen.get


def merged_statistics(
    spark: SparkSession,
    inputs: list[str],
    output: str,
    df_min: int = DEFAULT_DF_MIN,
    df_max: int | None = None,
) -> None:
    segments = sources.read_term_statistics(spark, *inputs)
    sinks.write_term_statistics(merge_term_statistics(segments, df_min=df_min, df_max=df_max), output)


def replaced_segment(
    spark: SparkSession,
    warc: str | list[str],
    segments: str,
    merged: str,
    output: str,
    segment: str,
    analyzer: str | Analyzer,
    version: str = "1.0",
) -> dict[str, int]:
    """Counts one segment anew: its folder of `segments` is replaced, and `output` gets the new totals.

    `merged` holds the totals so far, without a df threshold (none, if there are no segments yet).
    """
    pages, seen = _observed(spark, warc, version)
    new = written(compute_term_statistics(pages, analyzer, df_min=1), "segment")
    table = new.withColumn("segment", F.lit(segment))
    if sources.exists(spark, merged):
        old = sources.read_segments(spark, segments, sources.TERM_STATISTICS, segment)
        totals = merge_replacing(sources.read_term_statistics(spark, merged), old, new)
    else:
        totals = new
    sinks.write_term_statistics(totals, output)
    sinks.write_segments(table, segments)
    return seen.get


def dictionary(
    spark: SparkSession,
    statistics: str,
    output: str,
    expected_count: int | None = None,
    by_term: str | None = None,
) -> None:
    """Writes the dictionary in the order of ids, and a copy in the order of terms if asked to."""
    stats = sources.read_term_statistics(spark, statistics)
    sinks.write_dictionary(build_dictionary(stats, expected_count), output)
    if by_term:
        sinks.write_sorted(sources.read_dictionary(spark, output), by_term, "term")


def summary(spark: SparkSession, dictionary_path: str) -> DataFrame:
    return dictionary_summary(sources.read_dictionary(spark, dictionary_path))


def doc_vectors(
    spark: SparkSession,
    warc: str | list[str],
    output: str,
    dictionary_path: str,
    analyzer: str | Analyzer,
    version: str = "1.0",
    partitions: int | None = None,
    unique: bool = False,
) -> dict[str, int]:
    """Writes vectors in buckets by docid; returns the counters of pages and encoded terms."""
    terms = sources.read_dictionary(spark, dictionary_path)
    pages, seen = _observed(spark, warc, version)
    vectors = build_doc_vectors(pages, terms, analyzer, row_key=_WARC_KEY)
    encoded = Observation("vectors")
    vectors = vectors.observe(encoded, F.coalesce(F.sum("doc_len"), F.lit(0)).alias("encoded_terms"))
    buckets = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_doc_vectors(to_unique_vectors(vectors) if unique else vectors, output, buckets)
    return seen.get | encoded.get


def decoded_vectors(spark: SparkSession, vectors: str, output: str, dictionary_path: str) -> None:
    """Text lines `docid <tab> term|term|...`."""
    terms = sources.read_dictionary(spark, dictionary_path)
    decoded = decode_doc_vectors(sources.read_doc_vectors(spark, vectors), terms)
    joined = decoded.selectExpr("docid", "array_join(terms, '|') AS text")
    lines.write_lines(lines.plain_text_lines(joined), output)


def plain_text(
    spark: SparkSession, warc: str | list[str], output: str, version: str = "1.0"
) -> dict[str, int]:
    pages, seen = _observed(spark, warc, version)
    lines.write_lines(lines.plain_text_lines(dumps.dump_plain_text(pages)), output)
    return seen.get


def term_ids(
    spark: SparkSession,
    warc: str | list[str],
    output: str,
    dictionary_path: str,
    analyzer: str | Analyzer = "standard",
    version: str = "1.0",
    partitions: int | None = None,
) -> dict[str, int]:
    terms = sources.read_dictionary(spark, dictionary_path)
    pages, seen = _observed(spark, warc, version)
    dump = dumps.dump_term_ids(pages, terms, analyzer, row_key=_WARC_KEY)
    lines.write_lines(lines.term_id_lines(dump), output, partitions)
    return seen.get


def bm25_run(
    spark: SparkSession,
    vectors: str,
    output: str,
    dictionary_path: str,
    queries: str,
    k: int,
    unique: bool = False,
    cache: bool = False,
    **options,
) -> None:
    """One run.  With `cache`, the vectors are kept while the run needs them; see `bm25_runs` for more."""
    runs = {output: queries}
    bm25_runs(spark, vectors, runs, dictionary_path, k, unique, resident if cache else nullcontext, **options)


def bm25_runs(
    spark: SparkSession,
    vectors: str,
    runs: dict[str, str],
    dictionary_path: str,
    k: int,
    unique: bool = False,
    keep: Callable = resident,
    **options,
) -> None:
    """A run for each query file (output -> queries), over vectors read once and then kept in memory.

    Lines that are no query are written beside a run, if there are any.
    """
    terms = sources.read_dictionary(spark, dictionary_path)
    with keep(sources.read_doc_vectors(spark, vectors, unique=unique)) as docs:
        for output, queries in runs.items():
            asked = _asked(spark, queries, output)
            lines.write_run(ranking.bm25_topk(docs, terms, asked, k, **options), output)


def _asked(spark: SparkSession, queries: str, output: str) -> DataFrame:
    """The queries of a file; its rejected lines go to a folder beside the run."""
    rejects = sources.rejected_query_lines(spark.read.text(queries))
    if not rejects.isEmpty():
        lines.write_lines(rejects.select(F.concat_ws("\t", "reason", "line").alias("value")), f"{output.rstrip('/')}-rejects")
    return sources.read_queries(spark, queries)


def lm_run(
    spark: SparkSession,
    vectors: str,
    output: str,
    dictionary_path: str,
    queries: str,
    k: int,
    smoothing: float,
    unique: bool = False,
    **options,
) -> None:
    docs = sources.read_doc_vectors(spark, vectors, unique=unique)
    terms = sources.read_dictionary(spark, dictionary_path)
    asked = _asked(spark, queries, output)
    lines.write_run(ranking.lm_topk(docs, terms, asked, k, smoothing, **options), output)


def docno_mapping(
    spark: SparkSession, id_list: str, output: str, max_rows: int | None = None
) -> None:
    ids = sources.read_docid_list(spark, id_list, max_rows)
    build_docno_mapping(ids).write.mode("overwrite").parquet(output)
