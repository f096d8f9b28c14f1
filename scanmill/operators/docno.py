"""Document ids and dense document numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.operators.numbering import dense_ids_of_copies
from scanmill.runtime import has_at_most


def build_docno_mapping(ids: DataFrame) -> DataFrame:
    """(docno, docid): numbers from 0 in docid order; copies of an id get one each."""
    return dense_ids_of_copies(ids.select("docid"), "docid", "docno", start=0).select(
        "docno", "docid"
    )


# Lookups of up to this many ids read the mapping once and aggregate only their rows.
FEW_LOOKUPS = 1_000_000


def lookup_docno(mapping: DataFrame, docids: DataFrame) -> DataFrame:
    """(docid, docno): -1 unless the id occurs exactly once."""
    wanted = mapping
    if has_at_most(docids, FEW_LOOKUPS):
        wanted = mapping.join(F.broadcast(docids.select("docid")), "docid", "left_semi")
    unique = (
        wanted.groupBy("docid")
        .agg(F.count(F.lit(1)).alias("n"), F.min("docno").alias("docno"))
        .filter("n = 1")
    )
    return docids.join(unique, "docid", "left").select(
        "docid", F.coalesce("docno", F.lit(-1)).alias("docno")
    )


def lookup_docid(mapping: DataFrame, docnos: DataFrame) -> DataFrame:
    """(docno, docid): null past the end."""
    return docnos.join(mapping, "docno", "left").select("docno", "docid")
