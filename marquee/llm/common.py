"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this package: a maximal run of characters other than ASCII white space.
#: ``bytes.split()`` without arguments cuts UTF-8 text into the same words.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors and the driver share.

    Only a session whose executors live in the driver's process may go without it, as in tests: it gets a temporary
    folder. On a cluster a folder of one machine would lose rows silently, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='marquee-')}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def configured(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """Runs with a session setting changed."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: computed once, and its lineage is cut.

    A lost executor then costs a re-read of files, never a recomputation of what led to them. What was shuffled to make
    the table is removed with the job, so a chain of tables takes the disk of its largest step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/marquee-{name}-{uuid.uuid4().hex}"
    with configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` made and that nothing reads any more."""
    for table in tables:
        hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        hadoop.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def releasing(run: Callable) -> Callable:
    """A function for ``mapInArrow`` as it is, which gives free memory, Arrow's and the allocator's, back when its task has
    ended: the Python worker goes on to other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what numpy and Python freed
        if trim:
            trim(0)

    return whole


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
