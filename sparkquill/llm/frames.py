"""Small helpers for the operators: reading tables, the shared folder, and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns alone, by position, so that no further column of docs can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.  Where none is set, a folder of our own that goes with
    the process, for local masters alone: on a cluster each machine would have its own, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not hasattr(sc, "_own_scratch"):
        own = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc._own_scratch = f"file://{own}"
    return sc._own_scratch


def remove(spark: SparkSession, path: str) -> None:
    """The folder is deleted, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Of what is made and run inside, the shuffle files go as soon as it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside gets and gives Arrow batches of at most so many rows: of texts, either side holds a batch or more at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what follows doesn't go back to its inputs; the shuffle files on the way to it are gone."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new plan, as freed() counts when a plan is made
