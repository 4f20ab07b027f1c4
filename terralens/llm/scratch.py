"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else of setCheckpointDir, as a full address.

    Where neither is set, a local master gets a temporary folder, as driver and executors are one machine; any other master raises, as
    executors wouldn't see the driver's files.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        there = sc._jsc.sc().getCheckpointDir()
        if there.isDefined():
            got = there.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            got = f"file://{tempfile.mkdtemp(prefix='terralens-')}"
            sc.setCheckpointDir(got)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = sc._jvm.org.apache.hadoop.fs.Path(got)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: cuts the lineage, and a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Saves what ``make`` gives, and deletes the tables that were saved on the way to it: nothing reads them any more."""
    before = len(_made)
    out = save(make(), name)
    clean(spark, _made[before:-1])
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were saved within it. Results that read them must have been written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        clean(spark, _made[before:])


def clean(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes saved tables: those of ``paths``, or all that this process has made."""
    sc = spark.sparkContext
    for p in list(_made) if paths is None else list(paths):
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if p in _made:
            _made.remove(p)
