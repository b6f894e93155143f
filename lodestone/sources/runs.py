"""Runs that mustn't overlap: a lock in the run's folder, and a plan of what is left."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Locked(RuntimeError):
    """Another run holds the folder."""


@contextmanager
def run_lock(spark: SparkSession, folder: str) -> Iterator[None]:
    """Holds ``folder`` for one run; its lock file is made in one step or not at all, and goes at the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.lock")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    if not fs.createNewFile(path):
        raise Locked(f"another run holds {folder}; remove {folder}/.lock if it has died")
    try:
        yield
    finally:
        fs.delete(path, False)


def plan(todo: DataFrame, done: DataFrame | None, limit: int | None = None, key: str = "id") -> DataFrame:
    """What a run has to do: rows that aren't done, in the order of ``key``, at most ``limit`` of them."""
    left = todo if done is None else todo.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def summary(todo: DataFrame, done: DataFrame | None, limit: int | None = None, key: str = "id") -> DataFrame:
    """One row: total, done, planned, left_over."""
    total, ready = todo.count(), 0 if done is None else todo.join(done.select(key), key, "left_semi").count()
    planned = total - ready if limit is None else min(limit, total - ready)
    row = [(total, ready, planned, total - ready - planned)]
    return todo.sparkSession.createDataFrame(row, "total long, done long, planned long, left_over long")


__all__ = ["Locked", "plan", "run_lock", "summary"]
