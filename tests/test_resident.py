from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators.vectors import to_unique_vectors
from scanmill.runtime import resident

_DDL = (
    "docid string, terms array<struct<term_id:int,tf:int>>, doc_len int, "
    "`odd``name` array<struct<`a b`:string,c:array<int>>>, bare array<int>"
)


def test_rows_of_a_resident_table_are_what_they_were(spark):
    """Null arrays, null elements, and null fields of elements are three things."""
    rows = [
        ("a", [(1, 2), None, (3, None), (None, None)], 3, [("x", [1, None]), None], [1]),
        ("b", None, None, None, None),
        ("c", [], 0, [], []),
        (None, [(7, 1)], 1, [(None, None)], [None, 2]),
    ]
    df = spark.createDataFrame(rows, _DDL)
    with resident(df) as kept:
        assert kept.dtypes == df.dtypes
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))
    flat = spark.createDataFrame([("a", [3, 1, 3]), ("b", []), ("c", None)], "docid string, term_ids array<int>")
    unique = to_unique_vectors(flat)
    with resident(unique) as kept:
        assert kept.dtypes == unique.dtypes
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, unique.collect()))


def test_arrays_of_structs_are_kept_as_arrays_of_numbers(spark):
    """As structs, an element takes 32 bytes of a task that stores or reads a partition."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: (F.xxhash64("id", i) % 100_000).cast("int"))
    vectors = to_unique_vectors(spark.range(50).select(F.col("id").cast("string").alias("docid"), ids.alias("term_ids")))
    with resident(vectors) as kept:
        assert kept.count() == 50
        plan = kept._jdf.queryExecution().optimizedPlan()
        cached = [leaf for leaf in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size()))]
        types = [cached[0].schema().fields()[i].dataType().simpleString() for i in range(cached[0].schema().size())]
        assert "array<int>" in types and not any("struct" in t for t in types)
        held = cached[0].cacheBuilder().sizeInBytesStats().value()
    assert 0 < held < 50 * 300 * 16
