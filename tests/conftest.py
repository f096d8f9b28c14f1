from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scanmill import ship

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with a repeated word, a one-word, an empty and a tied document."""
    rows = [
        ("d1", "apple banana apple cherry"),
        ("d2", "banana banana date"),
        ("d3", "apple"),
        ("d4", ""),
        ("d5", "cherry date egg fig apple"),
        ("d6", "banana banana date"),
        ("d7", "zebra zebra zebra"),
        ("d8", "egg fig grape"),
        ("d9", "grape grape fig"),
    ]
    return spark.createDataFrame(rows, "docid string, content string")
