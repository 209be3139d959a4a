"""What the operators of this subpackage share: the shared folder, written tables, columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in local mode, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"
#: Spark setting under which a finished write gives up its shuffle files at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that setting is missing, local mode uses LOCAL_SHARED and a cluster
    the warehouse, which its executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return LOCAL_SHARED
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there.

    Cuts the lineage: what follows reads the files, also after executors are lost,
    so the shuffle files of the write are given up when it ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    for tables in _scratch:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no DataFrame in use reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end; only what lasts may be used after it."""
    tables: list[str] = []
    _scratch.append(tables)
    try:
        yield
    finally:
        _scratch.pop()
        for path in tables:
            removed(spark, path)


def lasting(df: DataFrame, tag: str) -> DataFrame:
    """Like written(), for what is read after the scratch that it is made in."""
    global _scratch
    held, _scratch = _scratch, []
    try:
        return written(df, tag)
    finally:
        _scratch = held


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
