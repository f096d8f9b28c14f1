"""How many documents a Python worker holds at once."""

from __future__ import annotations

from suite.base import BATCH_ROWS
from suite.catalog import REGISTRY

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_queries_bound_the_rows_of_a_batch(spark, tmp_path):
    rows = [(i, f"running dogs {i}") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for asked, held in ((None, BATCH_ROWS), (7, 7)):
        session = spark.newSession()
        if asked:
            session.conf.set(KEY, asked)
        found = REGISTRY["analyzer_porter"].run(session, str(tmp_path)).collect()
        assert sorted((r.docid, r.tokens) for r in found) == [(str(i), f"run|dog|{i}") for i in range(5)]
        assert session.conf.get(KEY) == str(held)
