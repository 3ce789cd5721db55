"""Cutting lineage: results that several branches read are written once, to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; where it names none, a folder of this process, which local masters alone may use."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_shared_folder"):
        sc._shared_folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, sc._shared_folder, ignore_errors=True)
    return f"file://{sc._shared_folder}"


def once(df: DataFrame) -> DataFrame:
    """df computed now and read back wherever it is used."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
