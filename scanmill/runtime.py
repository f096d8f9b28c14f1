"""Cutting lineage, scratch tables and size checks shared by the operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.storagelevel import StorageLevel

# Rows that a Python worker holds at once: documents are long rows.  A caller's setting stays.
BATCH_ROWS, _BATCHES = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_MADE: ContextVar[list[str] | None] = ContextVar("scratch tables made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scanmill-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(
    df: DataFrame, name: str = "table", buckets: int | None = None, by: str = "docid"
) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The copy survives lost executors, freezes generated ids, and gives Catalyst a
    columnar scan with real sizes.  With `buckets`, rows are stored hashed by a
    column, and grouping by it (and more) later needs no exchange.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if buckets is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    write_buckets(df, path, buckets, by)
    return read_buckets(spark, path, df.schema.toDDL(), by)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to; none is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that are made inside, when the work is done or has failed."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def _unless_none(prefix: str, parts: list[str]) -> Callable[[Column], Column]:
    def element(e: Column) -> Column:
        whole = F.struct(*(e.getField(f"{prefix}{j}").alias(p) for j, p in enumerate(parts)))
        return F.when(~e.getField(f"{prefix}none"), whole)

    return element


def _by_field(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """Columns that hold arrays of structs as one array a field, and those that make the structs again.

    An array of structs takes 16 bytes an element, and 8 for each field; one of numbers takes the numbers.
    """
    held, restored = [], []
    for i, field in enumerate(df.schema.fields):
        kind, name = field.dataType, f"`{field.name.replace('`', '``')}`"
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType) or not kind.elementType.fields:
            held.append(F.col(name).alias(f"c{i}"))
            restored.append(F.col(f"c{i}").alias(field.name))
            continue
        parts = kind.elementType.fieldNames()
        held += [F.col(name).getField(p).alias(f"c{i}_{j}") for j, p in enumerate(parts)]
        zipped = F.arrays_zip(*(F.col(f"c{i}_{j}") for j in range(len(parts))))
        if kind.containsNull:
            held.append(F.transform(name, lambda e: e.isNull()).alias(f"c{i}_none"))
            zipped = F.arrays_zip(F.col(f"c{i}_none"), *(F.col(f"c{i}_{j}") for j in range(len(parts))))
            zipped = F.transform(zipped, _unless_none(f"c{i}_", parts))
        else:
            named = StructType([StructField(f.name, f.dataType) for f in kind.elementType.fields])
            zipped = zipped.cast(ArrayType(named))
        restored.append(zipped.alias(field.name))
    return held, restored


@contextmanager
def resident(df: DataFrame) -> Iterator[DataFrame]:
    """A table kept in the executors' memory (and disk) for all runs made inside; released at the end.

    A task holds a partition of what is kept, too, when it stores or reads it, so arrays of structs
    are kept as an array for each field.
    """
    held, restored = _by_field(df)
    kept = df.select(*held).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept.select(*restored)
    finally:
        kept.unpersist()


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_buckets(df: DataFrame, path: str, buckets: int, by: str = "docid") -> None:
    """Rows hashed by a column into `buckets` sorted files, in a folder named by their number.

    A bucket of more than Spark's advisory partition size is written by several tasks, so it has
    several sorted files, and no task sorts more than that.  What the path held before is replaced.  The table that Spark needs for this is dropped
    from the catalog; the files stay.
    """
    spark = df.sparkSession
    remove(spark, path)
    table = f"buckets_{uuid.uuid4().hex}"
    writer = df.hint("rebalance", buckets, by).write.option("path", f"{path.rstrip('/')}/buckets={buckets}")
    writer.bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")


def read_buckets(spark: SparkSession, path: str, ddl: str, by: str = "docid") -> DataFrame:
    """A table, with its bucket layout declared if `write_buckets` wrote it.

    The declaration leaves the catalog at once; the frame keeps it.  Files of several such
    tables are read as plain files.
    """
    files = spark.read.option("recursiveFileLookup", "true")
    folder = F.regexp_extract("path", r"^(.*/buckets=[0-9]+)/[^/]*$", 1)
    folders = files.format("binaryFile").load(path).select(folder).distinct().limit(2).collect()
    if len(folders) != 1 or not folders[0][0]:
        return files.schema(ddl).parquet(path)
    location = folders[0][0]
    buckets = location.rpartition("=")[2]
    name = f"buckets_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
        f"INTO {buckets} BUCKETS LOCATION {_quoted(location)}"
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def keyed(df: DataFrame, row_key: list[str] | None) -> tuple[DataFrame, list[str]]:
    """A frame and the columns that tell its rows apart: the caller's, or a new `_doc`.

    A generated id is stable for rows read from files.  Rows that come out of a
    shuffle can change places when a lost task is run again, so name a key for
    those, or write them first.
    """
    if row_key:
        return df, list(row_key)
    return df.withColumn("_doc", F.monotonically_increasing_id()), ["_doc"]


def together(*names: list[str]) -> list[str]:
    """Column lists joined, each name once."""
    return list(dict.fromkeys(n for group in names for n in group))


def exploded(df: DataFrame, array: str, element: str) -> DataFrame:
    """One row per array element; the array column gives way to `element`.

    A plain explode makes Catalyst push `size(array) > 0` below the projection that
    computes the array, and so compute it twice; the outer form does not.
    """
    others = [c for c in df.columns if c != array]
    rows = df.select(*others, F.explode_outer(array).alias(element))
    return rows.filter(F.col(element).isNotNull())


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast: a count, with partial counts per task."""
    return df.count() <= rows


def bound_batches(spark: SparkSession) -> None:
    """Let a session without a setting of its own hand `BATCH_ROWS` rows at once to Python."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, BATCH_ROWS)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed.

    Adds it to the session's Python files, once, as `--py-files` would.
    """
    context = spark.sparkContext
    if getattr(context, "_scanmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="scanmill-ship-")) / package.name),
        "zip",
        root_dir=package.parent,
        base_dir=package.name,
    )
    context.addPyFile(archive)
    context._scanmill_shipped = True
