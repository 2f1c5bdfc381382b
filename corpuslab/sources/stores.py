"""Replacing a stored table, or some of its partitions, so that a lost job leaves what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _rename(spark: SparkSession, source: str, to: str) -> None:
    files, at = _files(spark, source)
    if not files.rename(at, _files(spark, to)[1]):
        raise OSError(f"{source} could not be renamed to {to}")


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, after a swap that stopped half way has been undone: what was set aside comes back if nothing took its
    place, and is dropped if something did."""
    aside = f"{path}.old"
    if exists(spark, aside):
        if exists(spark, f"{path}/_SUCCESS"):
            _files(spark, aside)[0].delete(_files(spark, aside)[1], True)
        else:
            files, at = _files(spark, path)
            files.delete(at, True)
            _rename(spark, aside, path)
    return path


def swap_in(rows: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """``rows`` as the table at ``path``, in whose place they come. They are written beside it first; only a table with
    its commit mark is renamed into place, so a job that fails leaves the old table, and rows may come from it."""
    spark, fresh = rows.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    recovered(spark, path)
    writer = rows.write.partitionBy(by) if by else rows.write
    try:
        writer.format(kind).save(fresh)
        if not exists(spark, f"{fresh}/_SUCCESS"):
            raise OSError(f"{fresh} has no commit mark")
        if exists(spark, path):
            _rename(spark, path, f"{path}.old")
        _rename(spark, fresh, path)
    finally:
        files, at = _files(spark, fresh)
        files.delete(at, True)
    recovered(spark, path)


def replace_partitions(rows: DataFrame, path: str, by: str = "source") -> None:
    """``rows`` in place of the partitions of ``path`` whose values of ``by`` they have; all others stay, and a value
    without a row now keeps its old ones. Spark stages the files and moves them in when the job commits, so running it
    again gives the same table, and a job that fails changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
