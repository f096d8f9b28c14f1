"""Every registered query against its SQL, and the inventory it covers."""

from __future__ import annotations

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

from suite.catalog import REGISTRY

SF_DIR = Path("/root/testdata/sf0.001")
INVENTORY = {
    "S": 8, "K": 6, "P": 12, "F": 8, "J": 8, "A": 10, "R": 9, "W": 8, "U": 5, "E": 14,
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_inventory_is_covered():
    covered = {line for e in REGISTRY.values() for line in e.covers}
    expected = {f"{kind}{n}" for kind, last in INVENTORY.items() for n in range(1, last + 1)}
    assert expected - covered == set()


def test_entry_module():
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(REGISTRY) <= set(module.oracle_sql()) <= set(module.queries())


@pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    entry = REGISTRY[name]
    result = entry.run(spark, str(SF_DIR))
    answer = duck.execute(entry.sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(result.columns)
    ours = canonical(result.columns, result.collect())
    assert ours == canonical(columns, answer.fetchall())
