"""Keeping an index in step with its files: the difference of two scans, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(scan: DataFrame, known: DataFrame) -> DataFrame:
    """(filename, new_hash, old_hash, status) of two tables (filename, filehash): status is new, deleted, changed or same.

    Files are matched by name, so a change is found whichever hash is greater, and repeated rows (one a chunk size) count once.
    """
    new = scan.select("filename", F.col("filehash").alias("new_hash")).distinct()
    old = known.select("filename", F.col("filehash").alias("old_hash")).distinct()
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") == F.col("old_hash"), "same").otherwise("changed")
    return new.join(old, "filename", "full_outer").withColumn("status", status)


def changed_or_new(difference: DataFrame) -> DataFrame:
    return difference.where(F.col("status").isin("new", "changed")).select("filename", F.col("new_hash").alias("filehash"))


def changed(difference: DataFrame) -> DataFrame:
    """Changed files with the hash they had."""
    return difference.where(F.col("status") == "changed").select("filename", F.col("old_hash").alias("filehash"))


def deleted(difference: DataFrame) -> DataFrame:
    return difference.where(F.col("status") == "deleted").select("filename", F.col("old_hash").alias("filehash"))


def chunks_of(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of mapping (filename, filehash, ...) that belong to files; both columns count, so a copy under another name stays."""
    return mapping.join(files.select("filename", "filehash").distinct(), ["filename", "filehash"], "left_semi")


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows of table whose keys aren't in gone."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def added(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.unionByName(more)


def statistics(difference: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return difference.agg(n("new"), n("changed"), n("deleted"), n("same"), F.count("new_hash").alias("n_scanned"), F.count("old_hash").alias("n_known"), F.countDistinct("new_hash").alias("n_hashes"))


def labels(*tables: DataFrame) -> DataFrame:
    """Distinct labels of several tables."""
    out = tables[0].select("label")
    for t in tables[1:]:
        out = out.union(t.select("label"))
    return out.where("label IS NOT NULL AND label <> ''").distinct()
