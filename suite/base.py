"""Registry of queries, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill import ship
from scanmill.operators.dictionary import build_dictionary
from scanmill.operators.documents import analyzed
from scanmill.operators.statistics import compute_term_statistics
from scanmill.operators.vectors import build_doc_vectors
from scanmill.runtime import BATCH_ROWS, bound_batches  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

DF_MIN = 2


@dataclass(frozen=True)
class Entry:
    run: Query
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `covers` names the inventory lines it stands for."""

    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            bound_batches(spark)
            return run(spark, sf_dir)

        REGISTRY[name] = Entry(shipped, tuple(covers.split()), sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(docid, content) of all documents."""
    raw = table(spark, sf_dir, "documents")
    return raw.select(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("content"), *extra)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docid, content) of all pages; content is HTML."""
    raw = table(spark, sf_dir, "pages")
    return raw.select(F.col("page_id").cast("string").alias("docid"), F.col("html").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): each benchmark item is a query."""
    raw = table(spark, sf_dir, "benchmark")
    return raw.select(F.col("item_id").alias("qid"), "text")


def statistics(spark: SparkSession, sf_dir: str, analyzer: str = "standard") -> DataFrame:
    return compute_term_statistics(documents(spark, sf_dir), analyzer, DF_MIN, html=False)


def dictionary(spark: SparkSession, sf_dir: str, analyzer: str = "standard") -> DataFrame:
    return build_dictionary(statistics(spark, sf_dir, analyzer))


def collection(
    spark: SparkSession, sf_dir: str, analyzer: str = "standard", **options
) -> tuple[DataFrame, DataFrame]:
    """Vectors and dictionary of all documents, whose texts are analyzed once for both."""
    docs = analyzed(documents(spark, sf_dir), analyzer, html=False)
    terms = build_dictionary(compute_term_statistics(docs, analyzer, DF_MIN, html=False))
    return build_doc_vectors(docs, terms, analyzer, html=False, row_key=["docid"], **options), terms
