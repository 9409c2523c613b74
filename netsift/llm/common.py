"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir, ship_package

_ONE_AT_A_TIME = threading.Lock()
#: Spark's setting that a query's shuffle files go at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run inside go at each one's end, not when the driver happens to collect its garbage."""
    with _ONE_AT_A_TIME:  # the setting is the session's
        before = spark.conf.get(_CLEAN_UP, "false")
        spark.conf.set(_CLEAN_UP, "true")
        try:
            yield
        finally:
            spark.conf.set(_CLEAN_UP, before)


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, of ``rows`` rows at most: a small table is not to be written as a file for each partition of what was made for large ones."""
    return df.repartition(1 + rows // 2000) if rows is not None and rows < 200_000 else df


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the reader nothing, and the
    shuffles behind ``df`` are not run again: their files go when the table
    is written. With ``by``, a folder for each value of that column.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a stashed table, once every table that was made of it is written."""
    files, sc = df.inputFiles(), df.sparkSession.sparkContext
    if files:
        path = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df`` (a shuffle join)."""
    with tidy(df.sparkSession):
        few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
