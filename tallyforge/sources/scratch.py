"""Intermediate tables in the folder that all executors share: they cut the lineage and keep plans small.

A table lives until the scope that was open when it was written is closed, or else until the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """What was written, and which settings were changed, since a scope was opened."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.settings: dict[str, str | None] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a table of written(), outlives this scope; the scope around it takes it over."""
        path = df._written_at
        if path in self.paths:
            self.paths.remove(path)
            outer = _scopes[: _scopes.index(self)]
            if outer:
                outer[-1].paths.append(path)
        return df


_scopes: list[Scope] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = had.get() if had.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It is written once, where checkpoint() would run the plan twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, where = _at(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(where)
    if _scopes:
        _scopes[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a table of written() that nobody reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        fs, where = _at(df.sparkSession, path)
        fs.delete(where, True)


def setting(spark: SparkSession, name: str, value: str) -> None:
    """Set a session setting; the open scope puts the old value back."""
    old = spark.conf.get(name, None)
    if old != value:
        if _scopes:
            _scopes[-1].settings.setdefault(name, old)
        spark.conf.set(name, value)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer than half as many partitions: for much work on each row of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Deletes, at its end, the intermediate tables written inside, and puts changed session settings back. Results that
    are to be read later must be stored, collected or kept inside."""
    mine = Scope()
    _scopes.append(mine)
    try:
        yield mine
    finally:
        _scopes.remove(mine)
        for path in mine.paths:
            fs, where = _at(spark, path)
            fs.delete(where, True)
        for name, old in mine.settings.items():
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)
