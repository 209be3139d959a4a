"""The folder that driver and executors share, and tables written to it between steps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session uses LOCAL_SHARED and a cluster its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return LOCAL_SHARED
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_statements"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The rows, written once and read from there: what reads them twice works them out once.

    path: where, if the caller removes them.
    """
    path = path or new_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no DataFrame in use reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
