"""Readers of the tables the engine itself writes, and of query and id files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.runtime import read_buckets

TERM_STATISTICS = "term string, df bigint, cf bigint"
DICTIONARY = "term_id int, term string, df bigint, cf bigint"
FLAT_VECTORS = "docid string, term_ids array<int>, doc_len int"
UNIQUE_VECTORS = "docid string, terms array<struct<term_id:int,tf:int>>, doc_len int"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_term_statistics(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of one or many statistics folders (globs allowed)."""
    return spark.read.schema(TERM_STATISTICS).parquet(*paths)


def read_segments(spark: SparkSession, path: str, ddl: str, *segments: str) -> DataFrame:
    """A table that `write_segments` wrote: all of it, or some segments, whose folders alone are read."""
    table = spark.read.schema(f"{ddl}, segment string").parquet(path)
    return table.filter(F.col("segment").isin(*segments)) if segments else table


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY).parquet(path)


# Values of one pushed filter; a longer list would be pushed as its range only.
_PUSHED = 10
# Keys that are looked up by pushed filters; more are a join's work.
MAX_PUSHED_KEYS = 1000


def read_keys(table: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of some keys, of a stored table: only row groups that may hold one are read.

    A table that `write_sorted` wrote by the key has few of those.
    """
    distinct = sorted(set(wanted))
    if len(distinct) > MAX_PUSHED_KEYS:
        raise ValueError(f"{len(distinct)} keys, at most {MAX_PUSHED_KEYS}: join the table instead")
    parts = [distinct[i : i + _PUSHED] for i in range(0, len(distinct), _PUSHED)] or [[]]
    return reduce(DataFrame.unionByName, [table.filter(F.col(key).isin(part)) for part in parts])


def read_doc_vectors(spark: SparkSession, *paths: str, unique: bool = False) -> DataFrame:
    """Vectors of one or many folders (globs allowed).

    One folder that was written in buckets by docid is read as such: grouping by docid,
    and ranking, then need no exchange of documents.
    """
    ddl = UNIQUE_VECTORS if unique else FLAT_VECTORS
    if len(paths) == 1:
        return read_buckets(spark, paths[0], ddl)
    return spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(*paths)


def read_documents(
    spark: SparkSession, path: str, docid: str, content: str, segment: str | Column | None = None
) -> DataFrame:
    """(docid, content) of a document table, pruned to a segment by a pushed filter."""
    df = spark.read.parquet(path)
    if segment is not None:
        df = df.filter(segment)
    return df.select(F.col(docid).cast("string").alias("docid"), F.col(content).alias("content"))


def _query_number() -> Column:
    return F.regexp_extract("value", r"^\s*(\d+)\s*:", 1)


def parse_query_lines(lines: DataFrame) -> DataFrame:
    """`qid:words` lines to (qid, text); lines of any other form are rejects."""
    text = F.regexp_replace("value", r"^[^:]*:", "")
    numbered = lines.select(_query_number().try_cast("bigint").alias("qid"), text.alias("text"))
    return numbered.filter("qid IS NOT NULL")


def rejected_query_lines(lines: DataFrame) -> DataFrame:
    """(line, reason) of the lines that are no query; blank lines are neither."""
    number = _query_number()
    reason = F.when(number != "", "number beyond 64 bits").when(F.contains("value", F.lit(":")), "no number")
    rejects = lines.filter((F.trim("value") != "") & number.try_cast("bigint").isNull())
    return rejects.select(F.col("value").alias("line"), reason.otherwise("no colon").alias("reason"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return parse_query_lines(spark.read.text(path))


def read_docid_list(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Document ids of a (bz2) comma-separated list: the text before the first comma."""
    lines = spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(1)).alias("docid"))
    return lines if max_rows is None else lines.limit(max_rows)
