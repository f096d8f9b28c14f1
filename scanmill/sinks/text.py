"""Writers of text files: token dumps, id dumps, ranked runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain_text_lines(dump: DataFrame) -> DataFrame:
    """`docid <tab> token|token|...` from (docid, text)."""
    return dump.select(F.concat_ws("\t", "docid", "text").alias("value"))


def term_id_lines(dump: DataFrame) -> DataFrame:
    """`docid <tab> [1, 2, 3]` from (docid, ids)."""
    return dump.select(F.concat_ws("\t", "docid", "ids").alias("value"))


def run_lines(run: DataFrame) -> DataFrame:
    """`qid Q0 docid rank score tag` from a ranked run."""
    fields = ["qid", F.lit("Q0"), "docid", "rank", "score", "tag"]
    fields = [F.col(f).cast("string") if isinstance(f, str) else f for f in fields]
    return run.select("qid", "rank", F.concat_ws(" ", *fields).alias("value"))


def write_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    lines = lines if partitions is None else lines.repartition(partitions)
    lines.select("value").write.mode("overwrite").text(path)


def write_run(run: DataFrame, path: str) -> None:
    """A run file, each query's lines together and in rank order."""
    lines = run_lines(run).repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank")
    lines.select("value").write.mode("overwrite").text(path)
