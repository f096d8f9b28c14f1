"""Writers of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.runtime import write_buckets


def write_term_statistics(stats: DataFrame, path: str) -> None:
    stats.select("term", "df", "cf").write.mode("overwrite").parquet(path)


def write_segments(table: DataFrame, path: str) -> None:
    """A table with a `segment` column, one folder a segment.

    Segments that the table holds replace those of the path; all others stay as they are.
    """
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("segment").parquet(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """One table; its files keep the id order, so id lookups prune row groups."""
    dictionary.select("term_id", "term", "df", "cf").write.mode("overwrite").parquet(path)


def write_sorted(table: DataFrame, path: str, key: str, row_group_bytes: int = 4 << 20) -> None:
    """A table for lookups: files hold ranges of a key, in order, in small row groups.

    A lookup of a few keys reads the row groups whose range and Bloom filter admit them.
    """
    ordered = table.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_doc_vectors(vectors: DataFrame, path: str, partitions: int | None = None) -> None:
    """Vectors as they come, or hashed by docid into `partitions` sorted files.

    The files are buckets: later grouping by docid, and ranking, need no exchange.
    """
    if partitions is None:
        vectors.write.mode("overwrite").parquet(path)
    else:
        write_buckets(vectors, path, partitions)
