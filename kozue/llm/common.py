"""Naming and storage helpers of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPY_KEY_BYTES = 16


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names like `bases` that clash with none of df's, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, k = f"__{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"__{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    """The top-level column of this very name, dots and backticks included."""
    return F.col(quoted(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only where none is set and the master is local, as in
    tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "kozue-checkpoints")
    return folder.rstrip("/")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs within has the files of its shuffles deleted when it ends; without that, they stay until the driver's garbage is
    collected. A task that still needs them makes them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from reliable storage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _shuffles_deleted(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def deleted(spark: SparkSession, path: str, at_end: bool = False) -> None:
    """Delete a folder of the shared file system, at once or when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_end:
        files.deleteOnExit(place)
    else:
        files.delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, for what is too large for checkpoints, which aren't compressed. The table
    is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    deleted(spark, path, at_end=True)
    return spark.read.schema(df.schema).parquet(path)


def content_key(text):
    """16 bytes that stand for a text in joins."""
    return F.unhex(F.md5(text))


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on: Arrow stages can't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


#: Rows of keys (some 16 bytes each) up to which a table of keys goes to all executors; beyond it, it is joined by key.
BROADCAST_KEYS = 1_000_000


def small(keys: DataFrame, limit: int | None = None) -> DataFrame:
    """keys, once computed; to be broadcast if they are few."""
    keys = checkpointed(keys)
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if limit is None else limit) else keys
