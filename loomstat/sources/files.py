"""Listing, making and committing files through the session's file systems, whatever the scheme of a path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """(file system, path) of a path; one without a scheme is the session's default, as for spark.read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _shown(status, like: str) -> str:
    """A path as it was asked for: with its scheme only if the pattern had one."""
    path = status.getPath()
    return path.toString() if "://" in like or like.startswith("file:") else path.toUri().getPath()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern with wildcards, by name; none if nothing does."""
    system, at = _at(spark, pattern)
    return sorted(_shown(s, pattern) for s in (system.globStatus(at) or []))


def in_folder(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder, by name; none if there is no such folder."""
    system, at = _at(spark, folder)
    if not system.exists(at):
        return []
    return sorted(_shown(s, folder) for s in system.listStatus(at) if s.isFile())


def made(spark: SparkSession, folder: str) -> str:
    """The folder, with those above it, made if need be."""
    system, at = _at(spark, folder)
    system.mkdirs(at)
    return folder


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file, written by a task row by row and named at last.

    The task writes into a folder beside the file; only when the job has ended is its file renamed to ``path``, so a job
    that fails leaves nothing there and one that is run again replaces it. Missing values are empty, booleans True and
    False.
    """
    spark = df.sparkSession
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    work = joined(folder, f"_{name}-{uuid.uuid4().hex}")
    shown = [F.when(F.col(f"`{c}`"), "True").when(~F.col(f"`{c}`"), "False").alias(c) if kind == "boolean" else F.col(f"`{c}`") for c, kind in df.dtypes]
    system, at = _at(spark, work)
    try:
        df.select(*shown).coalesce(1).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(work)
        parts = [s.getPath() for s in system.listStatus(at) if s.getPath().getName().startswith("part-")]
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        system.delete(target, False)
        if not parts:  # a table without partitions has no part; its header is all there is
            out = system.create(target, True)
            out.write(bytearray((",".join(df.columns) + "\n").encode()))
            out.close()
        elif not system.rename(parts[0], target):
            raise OSError(f"{path} could not be named")
    finally:
        system.delete(at, True)
