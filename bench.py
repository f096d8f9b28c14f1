"""Times the headline jobs; prints one JSON line.

Each stage reads what the stage before wrote, as the jobs do in production.  Every
stage runs twice: `queries` holds the second, warm run, `first_run` the first one,
which also pays for class loading and code generation.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanmill import ship
from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.dumps import dump_plain_text
from scanmill.operators.ranking import bm25_topk, lm_topk
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import build_doc_vectors, decode_doc_vectors, to_unique_vectors
from scanmill.runtime import written
from scanmill.sources.warc import read_warc, warc_documents
from suite.archives import page_archive
from suite.base import DF_MIN, documents, pages, queries

TOP_K = 1000


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    ship(spark)
    first: dict[str, float] = {}
    seconds: dict[str, float] = {}

    def timed(name: str, work: Callable[[], DataFrame]) -> DataFrame:
        for kept in (first, seconds):
            start = time.perf_counter()
            result = work()
            kept[name] = round(time.perf_counter() - start, 3)
        return result

    def stored(name: str, build: Callable[[], DataFrame], buckets: int | None = None) -> DataFrame:
        return timed(name, lambda: written(build(), name, buckets))

    def drained(name: str, build: Callable[[], DataFrame]) -> None:
        timed(name, lambda: build().write.format("noop").mode("overwrite").save())

    # The tables are one file each; a corpus has many.  Dealt over two files a core, untimed.
    parts = 2 * spark.sparkContext.defaultParallelism
    docs = written(documents(spark, sf_dir).repartition(parts, "docid"), "documents")
    html = written(pages(spark, sf_dir).repartition(parts, "docid"), "pages")
    asked = queries(spark, sf_dir)

    drained("term_statistics_standard", lambda: compute_term_statistics(docs, "standard", DF_MIN, html=False))
    stats = stored("term_statistics_porter", lambda: compute_term_statistics(docs, "porter", DF_MIN, html=False))
    drained("term_statistics_pages", lambda: compute_term_statistics(html, "porter", DF_MIN))
    terms = stored("dictionary", lambda: build_dictionary(stats))
    buckets = 2 * spark.sparkContext.defaultParallelism
    flat = stored(
        "doc_vectors",
        lambda: build_doc_vectors(docs, terms, "porter", html=False, row_key=["docid"]),
        buckets,
    )
    drained(
        "doc_vectors_large_dictionary",
        lambda: build_doc_vectors(docs, terms, "porter", html=False, row_key=["docid"], broadcast_terms=10_000),
    )
    unique = stored("unique_vectors", lambda: to_unique_vectors(flat), buckets)
    drained("decode_vectors", lambda: decode_doc_vectors(flat, terms))
    drained("decode_large_dictionary", lambda: decode_doc_vectors(flat, terms, broadcast_terms=10_000))
    archive = page_archive(spark, sf_dir, "1.0")
    drained(
        "archive_statistics",
        lambda: compute_term_statistics(warc_documents(read_warc(spark, archive)), "porter", DF_MIN),
    )
    drained("plain_text", lambda: dump_plain_text(docs, html=False))
    drained("bm25_flat", lambda: bm25_topk(flat, terms, asked, TOP_K))
    drained("bm25_unique", lambda: bm25_topk(unique, terms, asked, TOP_K))
    drained("lm_dirichlet", lambda: lm_topk(unique, terms, asked, TOP_K, 1000.0))
    drained("lm_jelinek_mercer", lambda: lm_topk(unique, terms, asked, TOP_K, 0.4))
    spark.stop()

    print(
        json.dumps(
            {
                "metric": "scan_retrieval_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
