"""Command line for spark-submit: `python -m scanmill <job> --input ... --output ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scanmill import ship
from scanmill.functions import scoring
from scanmill.functions.text import get_analyzer, read_stop_words
from scanmill.operators.dictionary import lookup_term_ids, lookup_terms
from scanmill.operators.docno import lookup_docid, lookup_docno
from scanmill.plans import jobs
from scanmill.runtime import scratch_cleared
from scanmill.sources.tables import read_dictionary, read_keys


def _length(text: str) -> float | None:
    return None if text == "measured" else float(text)


def _report(counters: dict[str, int]) -> None:
    for name, value in counters.items():
        print(f"{name}\t{value}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scanmill", description=__doc__)
    subs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *groups) -> argparse.ArgumentParser:
        sub = subs.add_parser(name)
        for add in groups:
            add(sub)
        return sub

    def io(p):
        p.add_argument("--input", required=True, action="append", help="path or glob, repeatable")
        p.add_argument("--output", required=True)

    def warc(p):
        p.add_argument("--warc-version", default="1.0", choices=("1.0", "0.18"))

    def analysis(p):
        p.add_argument("--preprocessing", default="porter", choices=("standard", "porter"))
        p.add_argument("--stop-words", help="file with one stop word per line")

    def dictionary(p):
        p.add_argument("--dictionary", required=True)

    def df_range(p):
        p.add_argument("--df-min", type=int, default=100)
        p.add_argument("--df-max", type=int)

    def retrieval(p):
        p.add_argument("--queries", required=True)
        p.add_argument("--topk", type=int, default=1000)
        p.add_argument("--unique", action="store_true", help="vectors hold unique terms")
        p.add_argument("--tie", default="docid", choices=("docid", "docid_desc"))
        p.add_argument("--tag", help="last field of the run's lines")

    count = job("count-records", warc)
    count.add_argument("--input", required=True, action="append")
    job("term-statistics", io, warc, analysis, df_range)
    job("merge-statistics", io, df_range)
    replaced = job("replace-segment", io, warc, analysis)
    replaced.add_argument("--segment", required=True)
    replaced.add_argument("--segments", required=True, help="statistics, one folder a segment")
    replaced.add_argument("--merged", required=True, help="totals so far, without a threshold")
    built = job("dictionary", io)
    built.add_argument("--count", type=int, help="expected number of terms")
    built.add_argument("--by-term", help="also write a copy in the order of terms, for lookups")
    look = job("lookup", dictionary)
    look.add_argument("--term", action="append", default=[])
    look.add_argument("--term-id", type=int, action="append", default=[])
    vectors = job("doc-vectors", io, warc, analysis, dictionary)
    vectors.add_argument("--partitions", type=int)
    vectors.add_argument("--unique", action="store_true", help="write unique terms with counts")
    job("decode-vectors", io, dictionary)
    job("plain-text", io, warc)
    job("term-ids", io, warc, analysis, dictionary).add_argument("--partitions", type=int)
    bm25 = job("bm25", io, analysis, dictionary, retrieval)
    bm25.add_argument("--documents", type=int, help="documents in the collection, else counted")
    bm25.add_argument("--all-documents", action="store_true", help="rank zero and negative scores too")
    bm25.add_argument("--cache", action="store_true")
    bm25.add_argument("--k1", type=float, default=scoring.K1)
    bm25.add_argument("--b", type=float, default=scoring.B)
    bm25.add_argument(
        "--average-length", type=_length, default=scoring.AVERAGE_LENGTH, help="a number, or `measured`"
    )
    lm = job("lm", io, analysis, dictionary, retrieval)
    lm.add_argument("--smoothing", type=float, default=scoring.SMOOTHING)
    lm.add_argument("--background", default="df", choices=("df", "cf"))
    job("docno-mapping", io).add_argument("--max", type=int)
    ids = job("docno-lookup")
    ids.add_argument("--index", required=True)
    ids.add_argument("--docid", action="append", default=[])
    ids.add_argument("--docno", type=int, action="append", default=[])
    return top


def _first(paths: list[str]) -> str:
    if len(paths) != 1:
        raise SystemExit("this job takes one --input")
    return paths[0]


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    job = args.job
    if hasattr(args, "preprocessing"):
        stop = read_stop_words(spark, args.stop_words) if args.stop_words else None
        analyzer = get_analyzer(args.preprocessing, stop)
    if job == "count-records":
        jobs.count_warc_records(spark, args.input, args.warc_version).show()
    elif job == "term-statistics":
        _report(
            jobs.term_statistics(
                spark, args.input, args.output, analyzer, args.warc_version, args.df_min, args.df_max
            )
        )
    elif job == "merge-statistics":
        jobs.merged_statistics(spark, args.input, args.output, args.df_min, args.df_max)
    elif job == "replace-segment":
        _report(
            jobs.replaced_segment(
                spark, args.input, args.segments, args.merged, args.output, args.segment, analyzer,
                args.warc_version,
            )
        )
    elif job == "dictionary":
        jobs.dictionary(spark, _first(args.input), args.output, args.count, args.by_term)
        jobs.summary(spark, args.output).show()
    elif job == "lookup":
        terms = read_dictionary(spark, args.dictionary)
        if args.term:
            wanted = spark.createDataFrame([(t,) for t in args.term], "term string")
            lookup_terms(read_keys(terms, "term", args.term), wanted).show(
                len(args.term), truncate=False
            )
        if args.term_id:
            wanted = spark.createDataFrame([(i,) for i in args.term_id], "term_id int")
            lookup_term_ids(read_keys(terms, "term_id", args.term_id), wanted).show(len(args.term_id), truncate=False)
    elif job == "doc-vectors":
        _report(
            jobs.doc_vectors(
                spark, args.input, args.output, args.dictionary, analyzer, args.warc_version,
                args.partitions, args.unique,
            )
        )
    elif job == "decode-vectors":
        jobs.decoded_vectors(spark, _first(args.input), args.output, args.dictionary)
    elif job == "plain-text":
        _report(jobs.plain_text(spark, args.input, args.output, args.warc_version))
    elif job == "term-ids":
        _report(
            jobs.term_ids(
                spark, args.input, args.output, args.dictionary, analyzer, args.warc_version,
                args.partitions,
            )
        )
    elif job == "bm25":
        jobs.bm25_run(
            spark, _first(args.input), args.output, args.dictionary, args.queries, args.topk,
            args.unique, args.cache, analyzer=analyzer, n_docs=args.documents,
            positive_only=not args.all_documents, k1=args.k1, b=args.b,
            average_length=args.average_length, tie=args.tie, tag=args.tag or "bm25",
        )
    elif job == "lm":
        jobs.lm_run(
            spark, _first(args.input), args.output, args.dictionary, args.queries, args.topk,
            args.smoothing, args.unique, analyzer=analyzer, background=args.background,
            tie=args.tie, tag=args.tag or "lmretrieval",
        )
    elif job == "docno-mapping":
        jobs.docno_mapping(spark, _first(args.input), args.output, args.max)
    elif job == "docno-lookup":
        mapping = spark.read.parquet(args.index)
        if args.docid:
            wanted = spark.createDataFrame([(d,) for d in args.docid], "docid string")
            lookup_docno(mapping, wanted).show(len(args.docid), truncate=False)
        if args.docno:
            wanted = spark.createDataFrame([(n,) for n in args.docno], "docno bigint")
            lookup_docid(mapping, wanted).select("docno", F.col("docid")).show(
                len(args.docno), truncate=False
            )


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"scanmill {args.job}").getOrCreate()
    ship(spark)
    with scratch_cleared(spark):
        run(spark, args)


if __name__ == "__main__":
    main()
