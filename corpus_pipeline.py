"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill import ship
from scanmill.llm.decontaminate import contaminated, find_contamination
from scanmill.llm.langid import UNDETERMINED, held_out, identify_language, train_profiles
from scanmill.llm.line_dedup import dedup_lines
from scanmill.llm.mixing import mix_sources
from scanmill.llm.ngram_join import keep_one_of_each
from scanmill.llm.queries import MIX_LEVELS, MIX_WEIGHTS
from scanmill.llm.registry import Entry
from scanmill.runtime import bound_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Language prediction and near-duplicate links have no SQL form.
ORACLE_SQL = None


# By so much the predicted language has to be nearer, as a cosine, than the one a row names.
CLEARLY_NEARER = 0.1


def _ready(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Name each document's language, and drop those whose language cannot be told.

    Null texts and texts without a letter go.  A missing `lang`, and one that the text is
    clearly further from than from the predicted language, is replaced by the prediction.
    """
    _ready(spark)
    profiles = train_profiles(docs.filter(~held_out("doc_id", 4, 2)).select("text", "lang"))
    named = identify_language(docs.select(*COLUMNS), profiles, claimed_col="lang")
    wrong = F.coalesce(F.col("score") >= F.col("claimed_score") + CLEARLY_NEARER, F.lit(True))
    lang = F.when(wrong, F.col("lang_pred")).otherwise(F.col("lang"))
    return named.filter(F.col("lang_pred") != UNDETERMINED).withColumn("lang", lang).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that an earlier document has; documents stay, with their new length."""
    _ready(spark)
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by runs of five words with a similarity of 0.8 or more, keep the first."""
    _ready(spark)
    return keep_one_of_each(docs.select(*COLUMNS), words=5, threshold=(4, 5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which one word in twenty, or more, stands in a benchmark passage."""
    _ready(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = find_contamination(docs.select(*COLUMNS), benchmark)
    return marked.filter(~contaminated()).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose as many tokens as there are, by the weights of domains, languages and sources."""
    _ready(spark)
    mixed = mix_sources(docs.select(*COLUMNS), MIX_LEVELS, MIX_WEIGHTS, share=(1, 1))
    return mixed.select(*COLUMNS, "domain", "n_tokens", "n_epochs")


STAGES = [
    ("language", identify),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


REGISTRY = {"pipeline": Entry(run, ORACLE_SQL)}
