from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.llm.line_dedup import dedup_lines


def kept(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, h1 string")
    found = dedup_lines(docs, **options)
    assert found.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    return sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))


def test_first_document_keeps_a_line(spark):
    shared = "A shared Line here"
    rows = [
        (2, f"  {shared.lower()}\t\nown line of two\nshort", 7, "x"),
        (1, f"{shared}\nshort\n{shared}", 7, None),
        (3, f"short\n{shared.upper()} \n\n", 7, "y"),
        (4, None, 7, "z"),
        (5, "", None, "z"),
        (None, shared, 7, "z"),
    ]
    one, two, three, four, five, nameless = kept(spark, rows)
    assert (one.text, one.n_lines, one.n_dropped) == (f"{shared}\nshort\n{shared}", 3, 0)
    assert (two.text, two.n_dropped) == ("own line of two\nshort", 1)
    assert (three.text, three.n_lines, three.n_dropped) == ("short\n\n", 4, 1)
    assert (four.text, four.n_lines, five.text, five.n_lines) == ("", 1, "", 1)
    assert nameless.text == shared and nameless.h1 == "z"


def test_rows_that_share_an_id_are_one_document(spark):
    line = "only in document seven"
    rows = [(7, line, 0, ""), (7, line, 0, ""), (8, "something else entirely", 0, "")]
    assert [r.n_dropped for r in kept(spark, rows)] == [0, 0, 0]


def test_length_counts_code_points_and_the_threshold_is_a_parameter(spark):
    rows = [(i, "éééééééééé\nééééééééé", 0, "") for i in (1, 2)]
    assert [r.text for r in kept(spark, rows)] == ["éééééééééé\nééééééééé", "ééééééééé"]
    assert [r.n_dropped for r in kept(spark, rows, min_docs=3)] == [0, 0]


def test_empty_table_and_long_text(spark):
    assert kept(spark, []) == []
    text = "\n".join(f"line number {i % 50_000} of many" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    found = dedup_lines(docs).select("doc_id", F.length("text").alias("n"), "n_dropped").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, len(text), 0), (2, 0, 100_000)]
